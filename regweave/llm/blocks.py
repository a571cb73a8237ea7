"""Blocks of documents and the messages they exchange.

Fingerprints of a corpus are far more numerous than its documents, so they do
not travel as one row each. Documents are packed into blocks of a bounded size,
written once to the shared folder. A block sorts and de-duplicates its own
fingerprints, so that a fingerprint which a third of all documents hold leaves a
block once, and sends one message to each bucket of the fingerprint space. A
bucket answers every message with what the whole corpus says about the
fingerprints in it, and the block goes on from there. With more buckets than a
block has fingerprints a message holds one of them, which is a plain row.

Block numbers are fixed when the blocks are written, so a task that runs again
after a lost executor sends the same messages.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.session import cut_lineage

BLOCK_BYTES = 2 << 20
MESSAGES = "bucket long, block long, data binary"
ANSWERS = "block long, level int, bucket long, data binary"


def release() -> None:
    """Give memory that a task no longer uses back to the system; workers live on."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most`` bytes of text."""
    for b in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.binary_length(b.column(column)).fill_null(0).to_pylist()):
            if size + n > most and i > at:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < len(b):
            yield b.slice(at)


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, payload, n_bytes), in the shared folder.

    A payload holds whole documents (id, text and the columns of ``carry``, named
    0, 1, ..), ``block_bytes`` of text at most
    unless a single document is longer, and 2**20 documents at most. Block numbers
    are below 2**43.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            sizes = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset:][:len(b) + 1])
            ends, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < len(b):
                start = ends[at - 1] if at else 0
                to = max(at + 1, min(int(np.searchsorted(ends, start + block_bytes, "right")), at + (1 << 20)))
                # the copy leaves behind the part of the buffers outside the slice
                part = b.take(pa.array(np.arange(at, to)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([packed(part)], pa.binary()),
                     pa.array([int(sizes[at:to].sum())], pa.int64())], ["block", "payload", "n_bytes"])
                number, at = number + 1, to
        release()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                         *(F.col(c).alias(str(i)) for i, c in enumerate(carry)))
    return cut_lineage(narrow.mapInArrow(build, "block long, payload binary, n_bytes long"))


def bucket_count(blocks: DataFrame, per_byte: float, bucket_bytes: int = 4 << 20) -> int:
    """Buckets of about ``bucket_bytes`` when a byte of text sends ``per_byte`` bytes."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    least = 2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total * per_byte / bucket_bytes))


def message_batches(rows: Iterable[tuple], names: list[str], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    types = [pa.int64()] * (len(names) - 1) + [pa.binary()]
    if "level" in names:
        types[names.index("level")] = pa.int32()

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > limit:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows that share the first column."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(len(b)):
            yield tuple(c[i].as_py() for c in b.columns)


def with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """(block, level, bucket, data): each block's payload, level -1, then its answers."""
    out = blocks.select("block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("bucket"),
                        F.col("payload").alias("data"))
    if not answers:
        return out
    for a in answers:
        out = out.unionByName(a)
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, "block").sortWithinPartitions("block", "level", "bucket")


Answers = dict[int, dict[int, bytes]]


def each_block(blocks: DataFrame, answers: list[DataFrame],
               fn: Callable[[int, pa.Table, Answers], Iterator[pa.RecordBatch]], schema: str,
               opened: Callable = unpacked) -> DataFrame:
    """Apply ``fn(block, documents, answers by level and bucket)`` to every block."""
    def run(batches):
        for block, rows in grouped(batches):
            got: Answers = {}
            for _, level, bucket, data in rows[1:]:
                got.setdefault(level, {})[bucket] = data
            if rows[0][1] == -1:  # else nothing but answers
                yield from fn(block, opened(rows[0][3]), got)
            del rows, got
        release()

    return with_answers(blocks, answers).mapInArrow(run, schema)


def stream_blocks(blocks: DataFrame, answers: list[DataFrame],
                  fn: Callable[[int, pa.Table, Iterator[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]], schema: str,
                  opened: Callable = unpacked) -> DataFrame:
    """Like ``each_block``, but the answers (level, bucket, data) come one after another and are not held."""
    def run(batches):
        for block, rows in groupby(each_row(batches), itemgetter(0)):
            _, level, _, payload = next(rows)
            if level == -1:  # else nothing but answers
                yield from fn(block, opened(payload), (r[1:] for r in rows))
        release()

    return with_answers(blocks, answers).mapInArrow(run, schema)


def send(blocks: DataFrame, answers: list[DataFrame],
         fn: Callable[[pa.Table, Answers], Iterable[tuple[int, bytes]]], opened: Callable = unpacked) -> DataFrame:
    """Messages (bucket, block, data) of every block."""
    def run(block, docs, got):
        yield from message_batches(((bucket, block, data) for bucket, data in fn(docs, got)),
                                    ["bucket", "block", "data"])
    return each_block(blocks, answers, run, MESSAGES, opened)


def relay(sent: DataFrame, level: int,
          fn: Callable[[list[int], list[bytes]], Iterable[tuple[int, bytes]]], written: bool = True) -> DataFrame:
    """What each bucket says to blocks: ``fn(blocks, messages)`` gives (block, data).

    Answers that are read once need not be ``written``.
    """
    def run(batches):
        def rows():
            for bucket, got in grouped(batches):
                for block, data in fn([r[1] for r in got], [r[2] for r in got]):
                    yield block, level, bucket, data
        yield from message_batches(rows(), ["block", "level", "bucket", "data"])
        release()

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, ANSWERS)
    return cut_lineage(out) if written else out


def resolve(sent: DataFrame, level: int,
            fn: Callable[[list[int], list[bytes]], Iterable[bytes]]) -> DataFrame:
    """Answer each bucket's messages by ``fn(blocks, messages)``, one answer a message."""
    return relay(sent, level, lambda blocks, messages: zip(blocks, fn(blocks, messages)))


WIDTH = 6


def short_message(hashes: np.ndarray, several: np.ndarray) -> bytes:
    """Hashes cut to ``WIDTH`` bytes, and whether each stands for more than one document."""
    return len(hashes).to_bytes(4, "little") + cut_low(hashes, WIDTH) + bits(several)


def in_two(_: list[int], messages: list[bytes]) -> list[bytes]:
    """Which hashes of short messages are in two of them or flagged in one."""
    counts = [int.from_bytes(m[:4], "little") for m in messages]
    keys = np.concatenate([from_low(m[4:4 + n * WIDTH], WIDTH) for n, m in zip(counts, messages)])
    flags = np.concatenate([from_bits(m[4 + n * WIDTH:], n) for n, m in zip(counts, messages)])
    groups = Groups(keys)
    kept = (groups.reduce(np.add, flags.astype(np.int64)) + groups.counts() > 1)[groups.inverse]
    return [bits(x) for x in np.split(kept, np.cumsum(counts)[:-1])]


# -- fingerprints ---------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd(seed: int) -> np.uint64:
    return mix(np.array([seed + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)


def window_hash(values: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive values."""
    n = max(0, len(values) - length + 1)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out += values[j:j + n] * odd(seed * 1000 + j)
    return mix(out)


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket from the upper half of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def route(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its entries in order) of an array of bucket numbers."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(b))):
        yield int(b[lo]), order[lo:hi]


class Groups:
    """Equal values of an array: ``values`` ascending and distinct, ``inverse``, and reductions."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        ordered = keys[self.order]
        first = np.ones(len(keys), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        self.starts = np.flatnonzero(first)
        self.values = ordered[self.starts]
        self.inverse = np.empty(len(keys), np.int64)
        self.inverse[self.order] = np.cumsum(first) - 1

    def reduce(self, ufunc: np.ufunc, column: np.ndarray) -> np.ndarray:
        return ufunc.reduceat(column[self.order], self.starts) if len(self.starts) else column[:0]

    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.order)))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def spans_of(mask: np.ndarray) -> np.ndarray:
    """(from, to) of every maximal run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Positions below ``n`` inside a window of ``length`` that begins at one of ``starts``."""
    step = np.bincount(starts, minlength=n + 1).astype(np.int64)[:n + 1]
    step -= np.bincount(starts + length, minlength=n + 1)[:n + 1]
    return np.cumsum(step[:n]) > 0


def cut_low(hashes: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_low(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes other than ASCII white space) and where each text's begin.

    A word's hash is the sum of a random value of each byte times a random odd
    number of its place, scrambled.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begins, ends = edge[::2], edge[1::2]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(begins, offsets)
    if not len(begins):
        return np.zeros(0, np.uint64), at
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    letters = joined[~space]
    place = mix(np.arange(int(sizes.max()), dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
    terms = _BYTE[letters] * place[np.arange(len(letters)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64)), at
