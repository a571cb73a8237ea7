"""Removal of word sequences that an earlier document holds too.

Level-wise doubling. The windows of the length asked for are too many to be
compared at once, so shorter ones are compared first: every window is
represented by the short window of least hash inside it, and only where that one
occurs in two documents is it extended, to at most twice its length, and compared
again, until the length asked for is reached or no candidate is left.

Edge cases: a null text has no words; a null id counts as larger than any other;
rows that share an id are separate documents, none of which is the earlier one;
documents below the window length lose nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regweave.llm import blocks as B

LAST_ID = np.iinfo(np.int64).max
KEPT = ("doc_id long, n_words long, n_removed long, "
        "spans array<struct<from_word:long,to_word:long>>, kept string")


def level_lengths(length: int, base: int = 7) -> list[int]:
    """Window lengths up to ``length``, each at most twice the one before."""
    out = [length]
    while out[0] > base:
        out.insert(0, math.ceil(out[0] / 2))
    return out


class _Block:
    """The windows of one block of documents and the candidates among them."""

    def __init__(self, docs: pa.Table, lengths: list[int]):
        self.ids = np.array([LAST_ID if x is None else x for x in docs["id"].to_pylist()], np.int64)
        self.texts = B.text_bytes(docs["text"])
        self.words, self.at = B.word_hashes(self.texts)
        self.lengths, n = lengths, lengths[-1]
        sizes = np.diff(self.at)
        doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - n + 1))
        firsts = np.cumsum(np.maximum(0, sizes - n + 1)) - np.maximum(0, sizes - n + 1)
        self.doc = doc
        self.starts = np.arange(len(doc)) - firsts[doc] + self.at[doc] if len(doc) else np.zeros(0, np.int64)
        self.least = self._least(lengths[0], n - lengths[0] + 1)

    def _least(self, length: int, reach: int) -> np.ndarray:
        """For each window, where the short window of least hash inside it begins."""
        if not len(self.starts):
            return self.starts
        h = B.window_hash(self.words, length, seed=1)
        best_at = self.starts.copy()
        best = h[best_at]
        for j in range(1, reach):
            other = h[self.starts + j]
            less = other < best
            best = np.where(less, other, best)
            best_at = np.where(less, self.starts + j, best_at)
        return best_at

    def level(self, j: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, B.Groups, np.ndarray]:
        """Windows of level ``j`` that stand for the living ones: (of window, doc), groups, hashes."""
        length = self.lengths[j]
        q = np.minimum(self.least, self.starts + self.lengths[-1] - length)[alive]
        doc = self.doc[alive]
        at, back = np.unique(q, return_inverse=True)
        owner = np.empty(len(at), np.int64)
        owner[back] = doc
        return back, owner, B.Groups(_at(self.words, at, length, 2 + j)), at

    def high(self, j: int, at: np.ndarray, groups: B.Groups) -> np.ndarray:
        """Second, independent hash of each distinct window."""
        firsts = at[groups.order[groups.starts]] if len(groups.starts) else at[:0]
        return _at(self.words, firsts, self.lengths[j], 50 + j)


def _at(values: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out += values[at + k] * B.odd(seed * 1000 + k)
    return B.mix(out)


def _survivors(block: _Block, got: B.Answers, buckets: int, upto: int) -> np.ndarray:
    """Which windows are still candidates before level ``upto``."""
    alive = np.arange(len(block.starts))
    for j in range(upto):
        back, _, groups, at = block.level(j, alive)
        kept = np.zeros(len(groups.values), bool)
        for bucket, idx in B.route(B.buckets_of(block.high(j, at, groups), buckets)):
            kept[idx] = B.from_bits(got[j][bucket], len(idx))
        alive = alive[kept[groups.inverse][back]]
    return alive


def _flagged(block: _Block, owner: np.ndarray, groups: B.Groups) -> tuple[np.ndarray, np.ndarray]:
    ids = block.ids[owner]
    return groups.reduce(np.minimum, ids), groups.reduce(np.maximum, ids)


def repeated_spans(docs: DataFrame, length: int = 13, base: int = 7,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word in a window of ``length`` words that a document of smaller id holds.

    Returns (doc_id, n_words, n_removed, spans, kept): the removed runs as word
    positions, and the kept words joined by one space.
    """
    lengths = level_lengths(length, base)
    blocks = B.write_blocks(docs, id_col, text_col)
    buckets = B.bucket_count(blocks, 0.4)
    answers: list[DataFrame] = []
    for j in range(len(lengths) - 1):
        sent = B.send(blocks, answers, _short_sender(lengths, j, buckets))
        answers.append(B.resolve(sent, j, B.in_two))
    last = len(lengths) - 1
    sent = B.send(blocks, answers, _full_sender(lengths, buckets))
    answers.append(B.resolve(sent, last, _least_ids))
    return B.each_block(blocks, answers, _remover(lengths, buckets), KEPT)


def _short_sender(lengths: list[int], j: int, buckets: int):

    def fn(docs: pa.Table, got: B.Answers) -> Iterator[tuple[int, bytes]]:
        block = _Block(docs, lengths)
        _, owner, groups, at = block.level(j, _survivors(block, got, buckets, j))
        least, most = _flagged(block, owner, groups)
        several = least != most
        # rows of one id in different blocks also count as two; the last level sorts that out
        for bucket, idx in B.route(B.buckets_of(block.high(j, at, groups), buckets)):
            yield bucket, B.short_message(groups.values[idx], several[idx])
    return fn


def _full_sender(lengths: list[int], buckets: int):
    last = len(lengths) - 1

    def fn(docs: pa.Table, got: B.Answers) -> Iterator[tuple[int, bytes]]:
        block = _Block(docs, lengths)
        _, owner, groups, at = block.level(last, _survivors(block, got, buckets, last))
        least, _ = _flagged(block, owner, groups)
        for bucket, idx in B.route(B.buckets_of(block.high(last, at, groups), buckets)):
            table, which = np.unique(least[idx], return_inverse=True)
            yield bucket, b"".join([len(idx).to_bytes(4, "little"), len(table).to_bytes(4, "little"),
                                    groups.values[idx].tobytes(), table.tobytes(),
                                    which.astype(np.uint32 if len(table) > 65535 else np.uint16).tobytes()])
    return fn


def _read_full(m: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = int.from_bytes(m[:4], "little"), int.from_bytes(m[4:8], "little")
    hashes = np.frombuffer(m, np.uint64, n, 8)
    table = np.frombuffer(m, np.int64, k, 8 + 8 * n)
    which = np.frombuffer(m, np.uint32 if k > 65535 else np.uint16, n, 8 + 8 * (n + k))
    return hashes, table[which]


def _least_ids(_: list[int], messages: list[bytes]) -> list[bytes]:
    """For each window, the least document of all, where it is below the block's own."""
    read = [_read_full(m) for m in messages]
    hashes = np.concatenate([h for h, _ in read])
    ids = np.concatenate([d for _, d in read])
    groups = B.Groups(hashes)
    least = groups.reduce(np.minimum, ids)[groups.inverse]
    cuts = np.cumsum([len(h) for h, _ in read])[:-1]
    out = []
    for own, all_ in zip(np.split(ids, cuts), np.split(least, cuts)):
        lower = all_ < own
        out.append(B.bits(lower) + all_[lower].tobytes())
    return out


def _remover(lengths: list[int], buckets: int):
    last = len(lengths) - 1

    def fn(_: int, docs: pa.Table, got: B.Answers) -> Iterator[pa.RecordBatch]:
        block = _Block(docs, lengths)
        alive = _survivors(block, got, buckets, last)
        back, owner, groups, at = block.level(last, alive)
        least, _most = _flagged(block, owner, groups)
        for bucket, idx in B.route(B.buckets_of(block.high(last, at, groups), buckets)):
            data = got[last][bucket]
            lower = B.from_bits(data, len(idx))
            least[idx[lower]] = np.frombuffer(data, np.int64, int(lower.sum()), (len(idx) + 7) // 8)
        hit = least[groups.inverse][back] < block.ids[block.doc[alive]]
        removed = B.cover(len(block.words), block.starts[alive][hit], lengths[-1])
        rows = []
        for i, text in enumerate(block.texts):
            own = text.split()
            mask = removed[block.at[i]:block.at[i + 1]]
            kept = [w for w, r in zip(own, mask) if not r] if mask.any() else own
            rows.append((len(own), int(mask.sum()), B.spans_of(mask).tolist(), b" ".join(kept)))
        n, gone, spans, kept = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [docs["id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
             pa.array([[{"from_word": a, "to_word": b} for a, b in s] for s in spans],
                      pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "spans", "kept"])
    return fn
