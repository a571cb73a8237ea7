"""Alignment of the tokens of two tokenizers over the same bytes, with corpus-wide link counts.

Tokens are byte intervals. All A and B tokens of a block of documents are lexsorted
by start; where a start reaches the running maximum of the ends before it, a group
begins, and inside a group each A token is linked with the B tokens it overlaps.

Documents are tokenized once, into blocks of token ids in the shared folder. How
many documents hold a pair of ids linked is counted per task, then by Spark, and the
blocks fetch the counts of their own pairs through buckets of the pair table, so no
process holds that table.

A long text is cut before single spaces between other characters. Neither tokenizer
has a token across such a cut (A's pattern begins a new piece there; no piece of B has
a space after another character, which is checked), so the parts are encoded one by one.
Where each merge of A's file makes the next id, joining the pair of least id is the same
as its list of merges, and a faster encoder of that kind is used for texts of characters
whose classes are the same in all versions of Unicode in use.

Edge cases: a null or empty text, and a text whose A or B tokens do not spell out a
space and the text, has no tokens; repeated rows are judged one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm import blocks as B
from regweave.session import cut_lineage

FOLDER = "/opt/tokenizers"
CUT = re.compile(r"(?<=\S)(?= \S)")
BLOCK_CHARS = 1 << 20
#: Characters of a part of a text, about.
PART_CHARS = 1 << 16
#: Latin, punctuation, kana, CJK and Hangul: characters that were classed before the encoders' tables part.
_SETTLED = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAIRS = 2_000_000
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "alignment string")


# -- the two tokenizers ---------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others for 256, 257, .."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their entries. Travels to tasks as the two paths; each task loads them once."""

    def __init__(self, byte_level: str, pieces: str):
        self.paths = byte_level, pieces

    def __reduce__(self):
        return Tokenizers, self.paths

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        out = Tokenizer.from_file(self.paths[0])
        out.encode_special_tokens = True
        return out

    @cached_property
    def b(self):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=self.paths[1])

    @cached_property
    def file(self) -> dict:
        with open(self.paths[0], encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        alphabet, vocabulary = byte_alphabet(), self.file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        out = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for entry, i in vocabulary.items():
            out[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        for entry, i in special.items():
            out[i] = entry.encode()
        return out

    @cached_property
    def by_least_id(self):
        """The faster encoder, or None where A's file is not of the kind that allows it."""
        vocabulary, split = self.file["model"]["vocab"], self.file["pre_tokenizer"]
        merged = [m if isinstance(m, str) else " ".join(m) for m in self.file["model"]["merges"]]
        plain = (split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
                 and self.file["normalizer"] is None and not self.file["model"].get("ignore_merges"))
        if not plain or any(vocabulary.get(m.replace(" ", "", 1)) != 256 + i for i, m in enumerate(merged)):
            return None
        import tiktoken
        return tiktoken.Encoding("a", pat_str=_PIECES, special_tokens={},
                                 mergeable_ranks={self.a_bytes[i]: i for i in range(256 + len(merged))})

    @cached_property
    def b_bytes(self) -> list[bytes]:
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("the piece model has a space after another character")
        return [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
                for i, x in enumerate(names)]

    def sizes(self) -> list[np.ndarray]:
        """Bytes of each entry of A and of B."""
        return [np.array([len(x) for x in t], np.uint16) for t in (self.a_bytes, self.b_bytes)]

    def encode_a(self, text: str) -> list[int]:
        if self.by_least_id is not None and _SETTLED.fullmatch(text):
            return self.by_least_id.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def document(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and of B; empty where they do not spell a space and the text."""
        a, b = [], []
        for part in parts(" " + text) if text else ():
            raw, x, y = part.encode(), self.encode_a(part), self.b.encode(part[1:])
            if not b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y)):
                return [], []
            a += x
            b += y
        return a, b


def parts(text: str) -> Iterator[str]:
    """``text`` cut at the first allowed place after every ``PART_CHARS`` characters."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + PART_CHARS)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def token_blocks(docs: DataFrame, both: Tokenizers, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(block, payload, n_bytes) in the shared folder; a payload has (id, a, b) of whole documents."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for part in B.text_slices(batches, 1, BLOCK_CHARS):
            texts = part.column(1).to_pylist()
            a, b = zip(*map(both.document, texts))
            held = pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.list_(pa.uint32())) for x in (a, b))], ["id", "a", "b"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([B.packed(held)], pa.binary()),
                 pa.array([sum(len(t or "") for t in texts)], pa.int64())], ["block", "payload", "n_bytes"])
            number += 1
        B.release()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(narrow.mapInArrow(build, "block long, payload binary, n_bytes long"))


# -- interval coalescing --------------------------------------------------------------------------

def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray):
    """Groups of overlapping intervals: number of the group of each A and of each B interval.

    Both sets ascend. All intervals are lexsorted by start; a group begins where a
    start reaches the running maximum of the ends before it.
    """
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = np.repeat([0, 1], [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[:len(a_start)], group[len(a_start):]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray,
             a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A index, B index) of all overlapping intervals; they are in the same group and follow each other there.

    Where a group has one interval of a side, that one overlaps all others in it.
    """
    n = int(max(a_group.max(initial=-1), b_group.max(initial=-1))) + 1
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    b_first = np.cumsum(n_b) - n_b
    low, high = b_first[a_group], (b_first + n_b)[a_group]
    many = np.flatnonzero((n_a[a_group] > 1) & (n_b[a_group] > 1))
    low[many] = np.searchsorted(b_end, a_start[many], "right")
    high[many] = np.searchsorted(b_start, a_end[many], "left")
    count = high - low
    of = np.repeat(np.arange(len(a_start)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count - low, count)


@lru_cache(1)
def _spelled(n: int) -> np.ndarray:
    """Every id below ``n`` followed by each of the three marks."""
    return np.array([f"{i}{c}".encode() for c in ",|;" for i in range(n)], object)


class Aligned:
    """The tokens of one block of documents, their groups and their links."""

    def __init__(self, docs: pa.Table, sizes: list[np.ndarray]):
        self.ids = docs["id"].combine_chunks()
        lists = [docs[c].combine_chunks() for c in ("a", "b")]
        self.a, self.b = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        self.n_a, self.n_b = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        ends = [np.cumsum(sizes[k][x], dtype=np.int64) for k, x in enumerate((self.a, self.b))]
        starts = [e - sizes[k][x] for k, (e, x) in enumerate(zip(ends, (self.a, self.b)))]
        self.a_group, self.b_group = coalesce(starts[0], ends[0], starts[1], ends[1])
        self.link_a, self.link_b = overlaps(starts[0], ends[0], starts[1], ends[1], self.a_group, self.b_group)
        self.doc_of_a = np.repeat(np.arange(len(self.ids)), self.n_a)
        self.link_doc = self.doc_of_a[self.link_a]
        self.pair = self.a[self.link_a] << 32 | self.b[self.link_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of ids, ascending, and the number of documents that hold each."""
        self.distinct, at = np.unique(self.pair, return_inverse=True)
        self.at = at
        once = np.unique(at * len(self.ids) + self.link_doc) // max(1, len(self.ids))
        return self.distinct, np.bincount(once, minlength=len(self.distinct))

    def per_document(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, of, 1 if weights is None else weights)
        return out

    def groups_of_documents(self) -> np.ndarray:
        return self.per_document(self.doc_of_a[np.flatnonzero(np.diff(self.a_group, prepend=-1))])

    def rendered(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document: ids of A and of B, group by group."""
        n = int(self.a_group[-1]) + 1 if len(self.a_group) else 0
        size_a, size_b = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
        place_a = np.arange(len(self.a)) + (upto_b - size_b)[self.a_group]
        place_b = np.arange(len(self.b)) + upto_a[self.b_group]
        mark = np.zeros(len(self.a) + len(self.b), np.int64)
        code = np.empty(len(mark), np.int64)
        code[place_a], code[place_b] = self.a, self.b
        mark[upto_a + upto_b - size_b - 1], mark[upto_a + upto_b - 1] = 1, 2
        names = _spelled(1 << int(code.max(initial=0)).bit_length())
        pieces = names[code + mark * (len(names) // 3)].tolist()
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return [b"".join(pieces[lo:hi])[:-1].decode() for lo, hi in zip(at, at[1:])]


# -- counts over the corpus -----------------------------------------------------------------------

def pair_counts(blocks: DataFrame, sizes: list[np.ndarray]) -> DataFrame:
    """(a, b, n, best): documents in which each pair is linked, and whether that is the most of its A id."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held))
            values, at = np.unique(keys, return_inverse=True)
            return values, np.bincount(at, n, len(values)).astype(np.int64)

        def flush():
            keys, n = merged()
            for lo in range(0, len(keys), 1 << 16):
                k = keys[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(n[lo:lo + (1 << 16)])], ["a", "b", "n"])
            held.clear()

        for (payload,) in B.each_row(batches):
            held.append(Aligned(B.unpacked(payload), sizes).pairs())
            if sum(len(k) for k, _ in held) > PAIRS:
                held[:] = [merged()]
                if len(held[0][0]) > PAIRS // 2:
                    yield from flush()
        if held:
            yield from flush()
        B.release()

    n = (blocks.select("payload").mapInArrow(count, "a long, b long, n long")
         .groupBy("a", "b").agg(F.sum("n").alias("n")))
    n = cut_lineage(n)
    return n.join(n.groupBy("a").agg(F.max("n").alias("most")), "a").select(
        "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _bucket(a, b, n: int):
    return (a * 1_000_003 + b) % n


def _tables(pairs: DataFrame, n: int) -> DataFrame:
    """The pair table as messages: (bucket, block -1, data), one for each bucket that has pairs."""
    def pack(batches):
        def rows():
            for bucket, got in B.grouped(batches):
                _, key, count, best = zip(*got)
                yield bucket, -1, np.array([key, count, best], np.int64).tobytes()
        yield from B.message_batches(rows(), ["bucket", "block", "data"])

    keyed = pairs.select(_bucket(F.col("a"), F.col("b"), n).alias("bucket"),
                         (F.col("a") * (1 << 32) + F.col("b")).alias("key"), "n", F.col("best").cast("long").alias("best"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(pack, B.MESSAGES)


def _answers(sent: DataFrame) -> DataFrame:
    """Counts of the pairs each block asked for: its bucket's table comes first, then the messages one by one."""
    def run(batches):
        def rows():
            table, of = None, None
            for bucket, block, data in B.each_row(batches):
                if block == -1:
                    table, of = np.frombuffer(data, np.int64).reshape(3, -1), bucket
                    continue
                if of != bucket:
                    raise ValueError("a bucket without its part of the pair table")
                at = np.searchsorted(table[0], np.frombuffer(data, np.int64))
                yield block, 0, bucket, (table[1, at] << 1 | table[2, at]).tobytes()
        yield from B.message_batches(rows(), ["block", "level", "bucket", "data"])
        B.release()

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(sent.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, B.ANSWERS))


def align_tokenizers(docs: DataFrame, byte_level: str = f"{FOLDER}/byte_bpe_50k.json",
                     pieces: str = f"{FOLDER}/piece_bpe_32k.model", id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, alignment).

    alignment: ids group by group, ``a1,a2|b1;a3|b2,b3``, empty without tokens. A pair
    counts as many documents as hold it linked; count_sum adds that over the links, and
    n_best is the number of links whose pair has the highest count of its A id.
    """
    both = Tokenizers(byte_level, pieces)
    sizes = both.sizes()
    blocks = token_blocks(docs, both, id_col, text_col)
    pairs = pair_counts(blocks, sizes)
    n = B.bucket_count(blocks, 0.3)

    def routed(found: Aligned) -> Iterator[tuple[int, np.ndarray]]:
        distinct, _ = found.pairs()
        return B.route(_bucket(distinct >> 32, distinct & 0xFFFFFFFF, n))

    def ask(payload: pa.Table, _: B.Answers):
        found = Aligned(payload, sizes)
        for bucket, idx in routed(found):
            yield bucket, found.distinct[idx].tobytes()

    def finish(_: int, payload: pa.Table, got: B.Answers) -> Iterator[pa.RecordBatch]:
        found = Aligned(payload, sizes)
        told = np.zeros(0, np.int64)
        for bucket, idx in routed(found):
            told = told if len(told) else np.zeros(len(found.distinct), np.int64)
            told[idx] = np.frombuffer(got[0][bucket], np.int64)
        of_link = told[found.at]
        columns = [found.n_a, found.n_b, found.groups_of_documents(), found.per_document(found.link_doc),
                   found.per_document(found.link_doc[(of_link & 1) == 1]), found.per_document(found.link_doc, of_link >> 1)]
        yield pa.RecordBatch.from_arrays(
            [found.ids, *(pa.array(c, pa.int64()) for c in columns), pa.array(found.rendered(), pa.string())],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "alignment"])

    sent = _tables(pairs, n).unionByName(B.send(blocks, [], ask))
    return B.each_block(blocks, [_answers(sent)], finish, ALIGNED)
