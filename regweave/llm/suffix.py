"""Suffix-array removal of long byte strings that occur more than once.

Every window of ``length`` bytes is represented by the anchor inside it, the
``ANCHOR`` bytes of least hash. Equal windows have equal anchors, so windows whose
anchor occurs once in the corpus are unique. The others meet in the bucket of
their anchor, where a suffix array decides: two-stage sorting of the texts around
the anchors, then common prefixes of adjacent suffixes.

An anchor with more than ``HOT`` occurrences (a passage that a large part of the
corpus quotes) is not sorted in one place. Its windows are spread over all buckets
by 128-bit digests, which decide equality there. Both ways give the same rows.

Edge cases: a null text is empty; rows with equal or null ids are separate
documents and match each other; texts below ``length`` bytes lose nothing; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regweave.llm import blocks as B

ANCHOR = 128
HOT = 2000
PIECE = 4 << 20
SORT_BYTES = 256 << 10
KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<from_byte:long,to_byte:long>>, kept binary"
_WIDTH = 6


# -- two-stage suffix sorting ------------------------------------------------------------------

def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes.

    Two stages: suffixes smaller than their successors are sorted directly, by
    first byte and then by comparison. One scan over the buckets of the first
    byte, in ascending order, induces the others, since a suffix larger than its
    successor comes after it and keeps its order among those of the same byte.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(t.astype(np.int16)))
    step[-1] = -1  # the empty suffix is the smallest
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller = step[following] > 0
    chars = text.decode("latin-1")
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(t[direct], kind="stable")]
    cuts = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
        own = direct[cuts[c]:cuts[c + 1]].tolist()
        own.sort(key=lambda i: chars[i:i + depth])
        bucket.append(np.array(own, np.int64))
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[t[before] > c]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            heads = np.flatnonzero(np.diff(first[order].astype(np.int16), prepend=-1))
            for part in np.split(before[order], heads[1:]):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: bytes, first: np.ndarray, second: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, up to ``limit``."""
    t = np.frombuffer(text + bytes(limit + 8), np.uint8).astype(np.uint64)
    words = np.zeros(len(t) - 7, np.uint64)
    for j in range(8):
        words |= t[j:len(t) - 7 + j] << np.uint64(8 * j)
    out = np.full(len(first), limit, np.int64)
    alive = np.arange(len(first))
    for off in range(0, limit, 8):
        x = words[first[alive] + off] ^ words[second[alive] + off]
        differs = x != 0
        low = x[differs]
        low &= ~low + np.uint64(1)
        out[alive[differs]] = np.minimum(limit, off + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        alive = alive[~differs]
        if not len(alive):
            break
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes occur again in any of them."""
    # UTF-8 never holds 0xFF, so shifting by one frees 0 as the end of a text
    joined = b"".join(t.translate(_SHIFTED) + b"\0" for t in texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - [len(t) + 1 for t in texts]
    is_window = np.zeros(len(joined) + 1, bool)
    for b, t in zip(begins, texts):
        is_window[b:b + max(0, len(t) - length + 1)] = True
    order = suffix_array(joined, length)
    order = order[is_window[order]]
    same = common_prefixes(joined, order[:-1], order[1:], length) >= length
    again = np.zeros(len(joined) + 1, bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return [again[b:b + max(0, len(t) - length + 1)] for b, t in zip(begins, texts)]


_SHIFTED = bytes((i + 1) % 256 for i in range(256))


# -- anchors -----------------------------------------------------------------------------------

def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive keys, from running minima in both directions of tiles."""
    n = len(keys)
    tiles = np.full((n + width - 1) // width * width + width, np.iinfo(np.uint64).max, np.uint64)
    tiles[:n] = keys
    tiles = tiles.reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _anchor_hashes(t: np.ndarray) -> np.ndarray:
    """Hash of every ``ANCHOR`` consecutive bytes, by doubling."""
    h, size, level = B.mix(t.astype(np.uint64) + np.uint64(1)), 1, 0
    while size < ANCHOR:
        h = h[:-size] * B.odd(2 * level) + h[size:] * B.odd(2 * level + 1)
        h ^= h >> np.uint64(29)
        size, level = 2 * size, level + 1
    return B.mix(h)


class _Block:
    """The cells of one block: runs of window starts that share an anchor."""

    def __init__(self, docs: pa.Table, length: int):
        self.texts = B.text_bytes(docs["text"])
        self.length = length
        self.joined = b"".join(self.texts)
        ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        self.at = np.concatenate([[0], ends]).astype(np.int64)
        self.hash, self.first, self.last = [], [], []
        t = np.frombuffer(self.joined, np.uint8)
        for lo in range(0, len(t), PIECE):
            self._cells(t, lo, ends)
        self.hash = np.concatenate(self.hash) if self.hash else np.zeros(0, np.uint64)
        self.first = np.concatenate(self.first) if self.first else np.zeros(0, np.int64)
        self.last = np.concatenate(self.last) if self.last else np.zeros(0, np.int64)
        self.groups = B.Groups(self.hash)

    def _cells(self, t: np.ndarray, lo: int, ends: np.ndarray) -> None:
        piece = t[lo:lo + PIECE + self.length - 1]
        if len(piece) < self.length:
            return
        h = _anchor_hashes(piece)
        low = np.uint64((1 << 24) - 1)
        keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = (_sliding_least(keys, self.length - ANCHOR + 1) & low).astype(np.int64)
        starts = np.arange(len(least)) + lo
        end = ends[np.minimum(np.searchsorted(ends, starts, "right"), len(ends) - 1)]
        ok = np.flatnonzero(starts + self.length <= end)
        if not len(ok):
            return
        anchor = least[ok]
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.hash.append(h[anchor[new]])
        self.first.append(starts[ok[new]])
        self.last.append(starts[ok[np.append(new[1:], len(ok)) - 1]])

    def cell(self, i: int) -> bytes:
        return self.joined[self.first[i]:self.last[i] + self.length]


def _bucket(anchors: np.ndarray, n: int) -> np.ndarray:
    """Bucket of anchors: their hashes are the least of many and so crowd near 0 unless mixed again."""
    return B.buckets_of(B.mix(anchors), n)


def _anchor_sender(length: int, buckets: int):
    def fn(docs: pa.Table, _: B.Answers) -> Iterator[tuple[int, bytes]]:
        g = _Block(docs, length).groups
        counts = np.minimum(g.counts(), 65535).astype(np.uint16)
        for bucket, idx in B.route(_bucket(g.values, buckets)):
            several = counts[idx] > 1
            yield bucket, b"".join([len(idx).to_bytes(4, "little"), B.cut_low(g.values[idx], _WIDTH),
                                    B.bits(several), counts[idx][several].tobytes()])
    return fn


def _count_anchors(_: list[int], messages: list[bytes]) -> list[bytes]:
    """Two bit arrays a message: which anchors occur again, and which are hot."""
    sizes = [int.from_bytes(m[:4], "little") for m in messages]
    keys, counts = [], []
    for n, m in zip(sizes, messages):
        keys.append(B.from_low(m[4:4 + n * _WIDTH], _WIDTH))
        at = 4 + n * _WIDTH
        several = B.from_bits(m[at:at + (n + 7) // 8], n)
        c = np.ones(n, np.int64)
        c[several] = np.frombuffer(m, np.uint16, -1, at + (n + 7) // 8)
        counts.append(c)
    groups = B.Groups(np.concatenate(keys))
    total = groups.reduce(np.add, np.concatenate(counts))[groups.inverse]
    return [B.bits(x > 1) + B.bits(x > HOT) for x in np.split(total, np.cumsum(sizes)[:-1])]


class _Candidates:
    """Cells of a block whose anchors occur again, one for each distinct text."""

    def __init__(self, block: _Block, answers: dict[int, bytes], buckets: int):
        g = block.groups
        repeated, hot = np.zeros(len(g.values), bool), np.zeros(len(g.values), bool)
        for bucket, idx in B.route(_bucket(g.values, buckets)):
            data, n = answers[bucket], (len(idx) + 7) // 8
            repeated[idx] = B.from_bits(data[:n], len(idx))
            hot[idx] = B.from_bits(data[n:], len(idx))
        self.block = block
        self.cold: dict[int, list[list]] = {}
        self.windows: dict[bytes, list[int]] = {}
        texts: dict[bytes, list] = {}
        for i in np.flatnonzero(repeated[g.inverse]):
            if hot[g.inverse[i]]:
                for s in range(block.first[i], block.last[i] + 1):
                    digest = hashlib.blake2b(block.joined[s:s + block.length], digest_size=16).digest()
                    self.windows.setdefault(digest, []).append(s)
            else:
                texts.setdefault(block.cell(i), []).append(i)
        for text, cells in texts.items():
            h = block.hash[cells[0]]
            bucket = int(_bucket(np.array([h]), buckets)[0])
            self.cold.setdefault(bucket, []).append([int(h), text, cells])
        for entries in self.cold.values():
            entries.sort(key=lambda e: (e[0], e[1]))
        self.spread: dict[int, list[bytes]] = {}
        for digest in sorted(self.windows):
            bucket = buckets + int.from_bytes(digest[:8], "little") * buckets // 2 ** 64
            self.spread.setdefault(bucket, []).append(digest)


def _cell_sender(length: int, buckets: int):
    def fn(docs: pa.Table, got: B.Answers) -> Iterator[tuple[int, bytes]]:
        found = _Candidates(_Block(docs, length), got.get(0, {}), buckets)
        squeeze = zstandard.ZstdCompressor(level=1)
        for bucket, entries in found.cold.items():
            head = np.array([(h, len(t), len(c) > 1) for h, t, c in entries], _ENTRY)
            yield bucket, b"C" + len(head).to_bytes(4, "little") + head.tobytes() + squeeze.compress(
                b"".join(t for _, t, _ in entries))
        for bucket, digests in found.spread.items():
            several = np.array([len(found.windows[d]) > 1 for d in digests])
            yield bucket, b"W" + len(digests).to_bytes(4, "little") + b"".join(digests) + B.bits(several)
    return fn


_ENTRY = np.dtype([("hash", "<u8"), ("size", "<u4"), ("several", "u1")])


def _decider(length: int):
    def fn(_: list[int], messages: list[bytes]) -> list[bytes]:
        return _windows_again(messages) if messages[0][:1] == b"W" else _cells_again(messages, length)
    return fn


def _windows_again(messages: list[bytes]) -> list[bytes]:
    sizes = [int.from_bytes(m[1:5], "little") for m in messages]
    keys = np.concatenate([np.frombuffer(m, "S16", n, 5) for n, m in zip(sizes, messages)])
    flags = np.concatenate([B.from_bits(m[5 + 16 * n:], n) for n, m in zip(sizes, messages)])
    groups = B.Groups(keys)
    again = (groups.reduce(np.add, flags.astype(np.int64)) + groups.counts() > 1)[groups.inverse]
    return [B.bits(x) for x in np.split(again, np.cumsum(sizes)[:-1])]


def _cells_again(messages: list[bytes], length: int) -> list[bytes]:
    """Suffix-sort the texts of each anchor; a text may stand for several equal ones."""
    expand = zstandard.ZstdDecompressor()
    by_anchor: dict[int, dict[bytes, list]] = {}
    order = []
    for m in messages:
        n = int.from_bytes(m[1:5], "little")
        head = np.frombuffer(m, _ENTRY, n, 5)
        body, at, own = expand.decompress(m[5 + n * _ENTRY.itemsize:]), 0, []
        for h, size, several in head.tolist():
            text, at = body[at:at + size], at + size
            seen = by_anchor.setdefault(h, {}).setdefault(text, [0, None])
            seen[0] += 1 + several
            own.append(seen)
        order.append((own, head["size"] - length + 1))
    batch: list[tuple[bytes, list]] = []
    size = 0

    def sort():
        for (_, seen), again in zip(batch, repeated_windows([t for t, _ in batch], length)):
            seen[1] = again
        batch.clear()

    for texts in by_anchor.values():
        if len(texts) > 1:
            batch.extend(texts.items())
            size += sum(map(len, texts))
            if size > SORT_BYTES:
                sort()
                size = 0
    if batch:
        sort()
    out = []
    for own, windows in order:
        parts = []
        for (count, again), n in zip(own, windows.tolist()):
            if count > 1:
                parts.append(b"\1")
            elif again is None or not again.any():
                parts.append(b"\0")
            else:
                parts.append(b"\2" + B.bits(again))
        out.append(b"".join(parts))
    return out


def _again(found: _Candidates, answers: dict[int, bytes]) -> np.ndarray:
    """Starts of the windows that occur again."""
    block, out = found.block, []
    for bucket, entries in found.cold.items():
        data, at = answers[bucket], 0
        for _, text, cells in entries:
            n, kind = len(text) - block.length + 1, data[at]
            at += 1
            if kind == 1:
                out.extend(block.first[c] + np.arange(n) for c in cells)
            elif kind == 2:
                which = np.flatnonzero(B.from_bits(data[at:at + (n + 7) // 8], n))
                at += (n + 7) // 8
                out.extend(block.first[c] + which for c in cells)
    for bucket, digests in found.spread.items():
        for d, again in zip(digests, B.from_bits(answers[bucket], len(digests))):
            if again:
                out.append(np.array(found.windows[d]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _remover(length: int, buckets: int, carry: tuple[str, ...]):
    def fn(_: int, docs: pa.Table, got: B.Answers) -> Iterator[pa.RecordBatch]:
        block = _Block(docs, length)
        found = _Candidates(block, got.get(0, {}), buckets)
        removed = B.cover(len(block.joined), _again(found, got.get(1, {})), length)
        rows = []
        for i, text in enumerate(block.texts):
            mask = removed[block.at[i]:block.at[i + 1]]
            spans = B.spans_of(mask)
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(spans) else text
            rows.append((len(text), int(mask.sum()), spans.tolist(), kept))
        n, gone, spans, kept = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [docs["id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
             pa.array([[{"from_byte": a, "to_byte": b} for a, b in s] for s in spans],
                      pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())]))),
             pa.array(kept, pa.binary()), *(c.combine_chunks() for c in docs.columns[2:])],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept", *carry])
    return fn


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id",
                   text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte in a string of ``length`` bytes that also starts anywhere else.

    Returns (doc_id, n_bytes, n_removed, spans, kept) and the columns named in
    ``carry``: removed byte runs and the remaining bytes, which may cut a character.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} bytes at least")
    clash = {"doc_id", "n_bytes", "n_removed", "spans", "kept"} & set(carry)
    if clash:
        raise ValueError(f"columns to carry have names of the result: {sorted(clash)}")
    blocks = B.write_blocks(docs, id_col, text_col, carry=carry)
    buckets = B.bucket_count(blocks, 0.3)
    anchors = B.resolve(B.send(blocks, [], _anchor_sender(length, buckets)), 0, _count_anchors)
    cells = B.resolve(B.send(blocks, [anchors], _cell_sender(length, buckets)), 1, _decider(length))
    schema = KEPT + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return B.each_block(blocks, [anchors, cells], _remover(length, buckets, carry), schema)


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, ..) with the repeated strings cut out of the texts.

    Where a cut goes through a character, the rest of it goes too; documents stay
    even if nothing is left of their text.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    private = tuple(f"_carried_{i}" for i in range(len(others)))  # apart from the names of the result
    out = remove_repeats(docs.withColumnsRenamed(dict(zip(others, private))), length, carry=private)
    text = whole_characters(F.col("kept"))
    return out.select("doc_id", text.alias("text"), *(F.col(p).alias(c) for p, c in zip(private, others))).withColumn(
        "n_chars", F.length("text").cast("long")).select(*docs.columns)


def whole_characters(column: Column) -> Column:
    """Text of UTF-8 bytes, without characters that are cut."""
    def decode(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))
    return F.pandas_udf(decode, "string")(column)
