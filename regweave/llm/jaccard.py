"""Exact Jaccard join of word shingles with multiple global token orders.

A document is its set of distinct shingles. Under any one order of all shingles,
two sets of similarity ``t`` share a token among the first ``n - ceil(t n) + 1`` of
each. The first order puts tokens that few documents hold in front, by frequency
classes counted over the whole corpus, and generates candidates; the same must
hold under further orders, which differ within each class, and a pair is verified
only if it passes all of them.

Steps, between blocks of documents and buckets of tokens:

1. equal sets meet by digest and are represented by one document;
2. buckets tell the frequency class of every token; sets without a token in their
   prefix that occurs elsewhere have no partner;
3. the remaining sets are sorted by their least token and cut into blocks, so that
   most near copies are neighbours; ranges of (token, set) split the sets of a
   token that very many have;
4. each token's bucket tells the blocks which sets to send to which other block.
   No pair is listed: a block finds the partners of a set that it receives through
   an index of its own sets, one message after another;
5. each pair is verified in one block, which keeps the number of links of each set
   and a spanning forest of them; the numbers are summed, and the forests combined
   before components are computed.

Edge cases: a document without words has no shingles, no links and its own id as
component; fewer words than a shingle are one shingle; rows with equal ids are
separate documents; a null id takes part, but is the component's id only if there
is no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm import blocks as B
from regweave.llm.components import connected_components
from regweave.session import cut_lineage

ORDERS = 3
#: Frequencies from which a token is in class 1, 2 and 3.
CLASSES = np.array([2, 8, 64])
SET_BYTES = 1 << 20
#: Buckets whose spanning forests are combined.
FAN_IN = 16
#: Requests that a bucket holds before it sends them.
REQUESTS = 1 << 20
#: Bytes of a token: two sets of a thousand tokens agree in one by chance with odds of 1 to 70 billion.
WIDTH = 7
_MASK = np.uint64((1 << 8 * WIDTH) - 1)
#: Bytes of a token that are counted, besides its bucket. Tokens that agree in them share a class.
COUNTED = 3
NO_ID = np.iinfo(np.int64).max
DESCRIBED = "row long, doc_id long, n_shingles long, least long, digest binary, text_sha256 string"
DEALT = "home long, least long, node long, data binary"


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Ascending hashes of the distinct shingles of each text, of ``WIDTH`` bytes."""
    words, at = B.word_hashes([t.lower() for t in texts])
    h = B.window_hash(words, size, seed=3) & _MASK if len(words) >= size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            own = np.sort(h[a:b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(B.window_hash(words[a:b], b - a, seed=4 + b - a) & _MASK)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, per_cent: int) -> int:
    return n - (per_cent * n + 99) // 100 + 1


def prefix(keys: np.ndarray, order: int, per_cent: int) -> np.ndarray:
    """First of ``keys`` (class above token, ascending) in one of the global orders."""
    n = prefix_size(len(keys), per_cent)
    if order == 0:
        return keys[:n]
    other = (keys & ~_MASK) | (B.mix(keys * B.odd(900 + order)) & _MASK)
    return keys[np.argpartition(other, n - 1)[:n]]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _describe(size: int):
    """Id, size and digest of the set of each document."""
    def run(block, docs, _):
        texts = B.text_bytes(docs["text"])
        sets = shingle_sets(texts, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block << 20 | i for i in range(len(sets))], pa.int64()), docs["id"].combine_chunks(),
             pa.array([len(s) for s in sets], pa.int64()), pa.array([int(s[0]) if len(s) else None for s in sets], pa.int64()),
             pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
             pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
            ["row", "doc_id", "n_shingles", "least", "digest", "text_sha256"])
    return run


class _Tokens:
    """Distinct tokens of a block, and in how many of its distinct sets each is."""

    def __init__(self, docs: pa.Table, size: int, buckets: int):
        self.sets = shingle_sets(B.text_bytes(docs["text"]), size)
        distinct = {s.tobytes(): s for s in self.sets if len(s)}
        self.groups = B.Groups(np.concatenate(list(distinct.values())) if distinct else np.zeros(0, np.uint64))
        self.routes = list(B.route(B.buckets_of(B.mix(self.groups.values), buckets)))

    def classes(self, answers: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.groups.values), np.uint64)
        for bucket, idx in self.routes:
            data, n = answers[bucket], (len(idx) + 7) // 8
            out[idx] = B.from_bits(data[:n], len(idx)) + 2 * B.from_bits(data[n:], len(idx)).astype(np.uint64)
        return out


def _token_counts(size: int, buckets: int):
    def fn(docs: pa.Table, _: B.Answers) -> Iterator[tuple[int, bytes]]:
        tokens = _Tokens(docs, size, buckets)
        counts = np.minimum(tokens.groups.counts(), 255).astype(np.uint8)
        for bucket, idx in tokens.routes:
            several = counts[idx] > 1
            yield bucket, b"".join([len(idx).to_bytes(4, "little"), B.cut_low(tokens.groups.values[idx], COUNTED),
                                    B.bits(several), counts[idx][several].tobytes()])
    return fn


def _classify(_: list[int], messages: list[bytes]) -> list[bytes]:
    """Class of each token: two bit arrays a message."""
    sizes = [int.from_bytes(m[:4], "little") for m in messages]
    keys, counts = [], []
    for n, m in zip(sizes, messages):
        keys.append(B.from_low(m[4:4 + n * COUNTED], COUNTED))
        at = 4 + n * COUNTED
        several = B.from_bits(m[at:at + (n + 7) // 8], n)
        c = np.ones(n, np.int64)
        c[several] = np.frombuffer(m, np.uint8, -1, at + (n + 7) // 8)
        counts.append(c)
    groups = B.Groups(np.concatenate(keys))
    total = groups.reduce(np.add, np.concatenate(counts))[groups.inverse]
    of = np.searchsorted(CLASSES, total, "right")
    return [B.bits(x & 1 > 0) + B.bits(x & 2 > 0) for x in np.split(of, np.cumsum(sizes)[:-1])]


def _dealer(size: int, buckets: int, per_cent: int):
    """(home, least token, node, keys) of each represented set that has a common prefix token."""
    def run(block, docs, got):
        mine = np.frombuffer(got.get(0, {}).get(0, b""), np.int64).reshape(-1, 2)
        if not len(mine):
            return
        tokens = _Tokens(docs, size, buckets)
        of, values = tokens.classes(got.get(1, {})), tokens.groups.values

        def rows():
            for node, home in mine.tolist():
                s = tokens.sets[node & ((1 << 20) - 1)]
                keys = np.sort(of[np.searchsorted(values, s)] << np.uint64(8 * WIDTH) | s)
                if keys[prefix_size(len(s), per_cent) - 1] > _MASK:
                    yield home, int(s[0]), node, keys.tobytes()
        yield from B.message_batches(rows(), ["home", "least", "node", "data"])
    return run


def _settle(dealt: DataFrame, set_bytes: int) -> DataFrame:
    """(block, payload): runs of the sets of a home by (least token, node), of a bounded size; a block has the number of its first node."""
    def run(batches):
        def out():
            part, held, of = [], 0, None
            for home, _, node, data in B.each_row(batches):
                if part and (home != of or held > set_bytes):
                    yield part[0][0], pickle.dumps(part, 5)
                    part, held = [], 0
                of = home
                part.append((node, np.frombuffer(data, np.uint64)))
                held += len(data)
            if part:
                yield part[0][0], pickle.dumps(part, 5)
        yield from B.message_batches(out(), ["block", "payload"])
        B.release()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(dealt.repartition(n, "home").sortWithinPartitions("home", "least", "node")
                       .mapInArrow(run, "block long, payload binary"))


class _Index:
    """Tokens of the sets of a block, ascending, with the set of each."""

    def __init__(self, tokens: list[np.ndarray]):
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]) if tokens else np.zeros(0, np.int64)
        order = np.argsort(flat)
        self.tokens, self.doc, self.n = flat[order], doc[order], len(tokens)

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set of the block holds."""
        lo = np.searchsorted(self.tokens, tokens, "left")
        n = np.searchsorted(self.tokens, tokens, "right") - lo
        lo, n = lo[n > 0], n[n > 0]
        if not len(n):
            return np.zeros(self.n, np.int64)
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
        return np.bincount(self.doc[at], minlength=self.n)


def _token_sender(buckets: int, per_cent: int):
    """Common prefix tokens of the settled sets: (token, set, size)."""
    def fn(part: list, _: B.Answers) -> Iterator[tuple[int, bytes]]:
        rows = []
        for k, (_node, keys) in enumerate(part):
            first = prefix(keys, 0, per_cent)
            first = first[first > _MASK]
            e = np.zeros(len(first), _TOKEN)
            e["token"], e["set"], e["size"] = first, k, len(keys)
            rows.append(e)
        entries = np.concatenate(rows)
        for bucket, idx in B.route(B.buckets_of(B.mix(entries["token"]), buckets)):
            yield bucket, entries[idx].tobytes()
    return fn


_TOKEN = np.dtype([("token", "<u8"), ("set", "<u4"), ("size", "<u4")])


def _requests(per_cent: int, most_held: int = REQUESTS):
    """For each set, the other blocks that hold sets of fitting size with the same token, in bounded pieces."""
    def fn(blocks: list[int], messages: list[bytes]) -> Iterator[tuple[int, bytes]]:
        e = np.concatenate([np.frombuffer(m, _TOKEN) for m in messages])
        home = np.repeat(np.array(blocks, np.int64), [len(m) // _TOKEN.itemsize for m in messages])
        order = np.lexsort([home, e["token"]])
        e, home = e[order], home[order]
        cuts = np.flatnonzero(np.append(True, e["token"][1:] != e["token"][:-1]))
        wanted: dict[int, list[np.ndarray]] = {}
        held = 0

        def flush():
            for block, pairs in wanted.items():
                yield block, np.unique(np.concatenate(pairs), axis=0).tobytes()
            wanted.clear()

        for a, b in zip(cuts, np.append(cuts[1:], len(e))):
            if b - a < 2 or home[a] == home[b - 1]:
                continue  # neighbours find each other at home
            size, at, number = e["size"][a:b].astype(np.int64), home[a:b], e["set"][a:b].astype(np.int64)
            ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1
            begins = np.concatenate([[0], ends[:-1]])
            least = np.minimum.reduceat(size, begins)
            most = np.maximum.reduceat(size, begins)
            for k, (first, end) in enumerate(zip(begins[:-1].tolist(), ends[:-1].tolist())):
                # sets of block k go to the blocks after it
                step = max(1, most_held // (len(begins) - k))
                for i in range(first, end, step):
                    n = size[i:min(i + step, end), None]
                    row, to = np.nonzero((most[None, k + 1:] * 100 >= per_cent * n) & (n * 100 >= per_cent * least[None, k + 1:]))
                    if len(row):
                        wanted.setdefault(int(at[i]), []).append(np.stack([number[i + row], at[begins[k + 1 + to]]], axis=1))
                        held += len(row)
                    if held > most_held:
                        yield from flush()
                        held = 0
        yield from flush()
    return fn


def _shipper(block: int, part: list, got: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Copies of the requested sets, packed by the block they go to."""
    pairs, held, size = np.zeros((0, 2), np.int64), [], 0
    for _, _, data in got:
        held.append(np.frombuffer(data, np.int64).reshape(-1, 2))
        size += len(held[-1])
        if size > max(REQUESTS, len(pairs)):
            pairs, held, size = np.unique(np.concatenate([pairs, *held]), axis=0), [], 0
    pairs = np.unique(np.concatenate([pairs, *held]), axis=0)
    if not len(pairs):
        return

    def out():
        for to, idx in B.route(pairs[:, 1]):
            own = [part[k] for k in pairs[idx, 0]]
            yield to, block, b"".join([
                len(own).to_bytes(4, "little"), np.array([x[0] for x in own], np.int64).tobytes(),
                np.array([len(x[1]) for x in own], np.int64).tobytes(), *(x[1].tobytes() for x in own)])
    yield from B.message_batches(out(), ["bucket", "block", "data"])


def _verifier(per_cent: int, homes: int):
    """Of the links of each block: their number by node, to even buckets by node, and a spanning forest, to an odd one."""
    def run(block, part, got):
        nodes = np.array([x[0] for x in part], np.int64)
        sets = [x[1] for x in part]
        sizes = np.array([len(s) for s in sets], np.int64)
        full = _Index(sets)
        index = [_Index([prefix(s, k, per_cent) for s in sets]) for k in range(ORDERS)]
        n_links = np.zeros(len(part), np.int64)
        group = np.arange(len(part))  # sets of the block that are connected so far
        others, edges = [], []

        def partners(keys, after):
            """Sets from ``after`` on that are similar to ``keys``."""
            n = len(keys)
            ok = (sizes * 100 >= per_cent * n) & (n * 100 >= per_cent * sizes)
            ok[:after] = False
            for k in range(ORDERS):
                if not ok.any():
                    return np.zeros(0, np.int64)
                ok &= index[k].shared(prefix(keys, k, per_cent)) > 0
            if not ok.any():
                return np.zeros(0, np.int64)
            same = full.shared(keys)
            return np.flatnonzero(ok & (same * 100 >= per_cent * (sizes + n - same)))

        def connect(node, found, own):
            """``own``: the group of ``node`` itself, or -1."""
            groups, one = np.unique(group[found], return_index=True)
            new = groups != own
            edges.extend((node, other) for other in nodes[found[one[new]]].tolist())
            if len(groups) > 1 or new.any():
                group[np.isin(group, groups)] = groups[0] if own < 0 else own

        for i, s in enumerate(sets):
            found = partners(s, i + 1)
            if len(found):
                n_links[i] += len(found)
                n_links[found] += 1
                connect(int(nodes[i]), found, group[i])
        for _, _, data in got:
            n = int.from_bytes(data[:4], "little")
            theirs = np.frombuffer(data, np.int64, n, 4)
            size = np.frombuffer(data, np.int64, n, 4 + 8 * n)
            for node, s in zip(theirs.tolist(), np.split(np.frombuffer(data, np.uint64, -1, 4 + 16 * n), np.cumsum(size)[:-1])):
                found = partners(s, 0)
                if len(found):
                    others.append((node, len(found)))
                    n_links[found] += 1
                    connect(node, found, -1)
        if edges:
            linked = np.flatnonzero(n_links)
            counts = np.concatenate([np.stack([nodes[linked], n_links[linked]], axis=1),
                                     np.array(others, np.int64).reshape(-1, 2)])
            rows = [(2 * bucket, block, counts[idx].tobytes()) for bucket, idx in
                    B.route(B.buckets_of(B.mix(counts[:, 0].astype(np.uint64)), homes))]
            to = int(B.buckets_of(B.mix(np.array([block], np.uint64)), homes)[0])
            rows.append((2 * to + 1, block, np.array(edges, np.int64).tobytes()))
            yield from B.message_batches(rows, ["bucket", "block", "data"])
    return run


def _spanning(pairs: np.ndarray) -> bytes:
    """Edges that connect what ``pairs`` connect, one fewer than nodes at most."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for u, v in pairs.tolist():
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((u, v))
    return np.array(edges, np.int64).tobytes()


def _sum_counts(_: list[int], messages: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Number of links of each node: each pair is verified in one block only."""
    pairs = np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 2) for m in messages])
    groups = B.Groups(pairs[:, 0])
    yield 0, np.stack([groups.values, groups.reduce(np.add, pairs[:, 1])], axis=1).tobytes()


def _one_forest(_: list[int], messages: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """One spanning forest of those of a few blocks or buckets, which a large group of near copies has in common."""
    yield 1, _spanning(np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 2) for m in messages]))


def _pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    def fn(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                x = np.frombuffer(data, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], [first, second])
    return rows.select("data").mapInArrow(fn, f"{first} long, {second} long")


def _homes(sets: DataFrame, n: int) -> DataFrame:
    """(row, home): ranges of about equal numbers of sets by (least token, node), so that no token's sets need one home."""
    return sets.repartitionByRange(n, "least", "node").select(
        F.col("node").alias("row"), F.spark_partition_id().cast("long").alias("home"))


def _packed_rows(rows: DataFrame) -> DataFrame:
    """The (row, home) of ``rows`` as one answer to each block."""
    def fn(batches):
        def out():
            for block, held in B.grouped(batches):
                yield block, 0, 0, np.array([r[1:] for r in held], np.int64).tobytes()
        yield from B.message_batches(out(), ["block", "level", "bucket", "data"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.shiftright("row", 20).alias("block"), "row", "home")
    return cut_lineage(keyed.repartition(n, "block").sortWithinPartitions("block", "row").mapInArrow(fn, B.ANSWERS))


def similar_documents(docs: DataFrame, per_cent: int = 75, shingle: int = 5, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links, component_id, first, text_sha256) of every document.

    Documents of one class have equal sets; n_links counts the other classes whose
    similarity is ``per_cent`` or more; component_id is the smallest id reachable
    by links and equality, and first marks one document of each component, that of
    this id.
    """
    blocks = B.write_blocks(docs, id_col, text_col)
    buckets = B.bucket_count(blocks, 0.5, 1 << 20)
    described = cut_lineage(B.each_block(blocks, [], _describe(shingle), DESCRIBED))
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("least_id"), F.col("row").alias("node"))
    equal = cut_lineage(described.filter("digest is not null").groupBy("digest").agg(F.min(order).alias("first"), F.first("least").alias("least"))
                        .select("digest", "least", "first.*"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = _packed_rows(_homes(equal, 4 * n))
    classes = B.resolve(B.send(blocks, [], _token_counts(shingle, buckets)), 1, _classify)
    homes = max(1, math.ceil(buckets / 2))
    dealt = B.each_block(blocks, [reps, classes], _dealer(shingle, buckets, per_cent), DEALT)
    settled = _settle(dealt, SET_BYTES)
    tokens = B.send(settled, [], _token_sender(buckets, per_cent), pickle.loads)
    wanted = B.relay(tokens, 2, _requests(per_cent))
    shipped = B.stream_blocks(settled, [wanted], _shipper, B.MESSAGES, pickle.loads)
    arrived = shipped.select(F.col("bucket").alias("block"), F.lit(3).alias("level"), F.col("block").alias("bucket"), "data")
    links = cut_lineage(B.stream_blocks(settled, [arrived], _verifier(per_cent, homes), B.MESSAGES, pickle.loads))
    counts = _pairs(B.relay(links.filter("bucket % 2 = 0"), 0, _sum_counts), "node", "n_links")
    forests = B.relay(links.filter("bucket % 2 = 1"), 0, _one_forest).select(
        F.floor(F.col("bucket") / (2 * FAN_IN)).alias("bucket"), F.col("bucket").alias("block"), "data")
    roots = connected_components(_pairs(B.relay(forests, 0, _one_forest), "u", "v"))
    linked = counts.join(roots, "node")
    least = equal.join(roots, "node").groupBy("root").agg(F.min(F.struct("least_id", "node")).alias("first"))
    linked = linked.join(least, "root").select(
        "node", "n_links", F.col("first.least_id").alias("component"), F.col("first.node").alias("keeper"))
    members = described.join(equal.join(linked, "node", "left"), "digest", "left")
    valid = lambda c: F.when(c != NO_ID, c)
    return members.select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(valid(F.col("least_id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(valid(F.coalesce("component", "least_id"))).alias("component_id"),
        (F.col("row") == F.coalesce("keeper", "node", "row")).alias("first"), "text_sha256")


def one_of_each(docs: DataFrame, per_cent: int = 75, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ..) that come first in their component, one of each."""
    kept = similar_documents(docs, per_cent, shingle).filter("first").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__h", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    rows = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["__id"]) & (keyed["__h"] == kept["__sha"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__h"]).drop("__h")
