"""How far the sources of a language differ in the terms they use.

All pairs of groups (language, source) are compared over all terms of the
language, so the work is a cube: group x group x term. It is cut along all three
axes. A slice is what one block of groups says about one block of terms; it is
replicated to every cell (group block, group block, term block) it is part of. A
task that owns a cell has the two slices it needs, computes the partial divergence
of each pair of groups in it, and the partial sums are added along the term axis.
A slice holds ``GROUP_BLOCK`` groups and ``TERM_BLOCK`` terms on average, whatever
the size of the corpus, of a source or of the vocabulary.

Arithmetic is on integers. A share is 1 + floor(SCALE * (count + 5) / (N + 5 V)).

Edge cases: a null text, language or source is the empty string; a group without
terms has the least share of each term; a language without kept terms has pairs of
value 0; repeated rows count again; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.llm import blocks as B
from regweave.operators.skew import salted_join
from regweave.session import cut_lineage

SCALE = 1_000_000_000
SMOOTH = 5
GROUP_BLOCK = 64
TERM_BLOCK = 2048
HELD = 300_000
#: Letters of ASCII, lowered, and all bytes of characters beyond it; the rest are gaps.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lowered."""
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """(lang, source, term, c, d): occurrences of each term in each group, and documents that hold it."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (count, within) in held.items():
                names = list(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()),
                     pa.array(names, pa.binary()).cast(pa.string()), pa.array(count.values(), pa.int64()),
                     pa.array([within[t] for t in names], pa.int64())], ["lang", "source", "term", "c", "d"])
            held.clear()

        for b in batches:
            for part in B.text_slices(iter([b]), 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                              B.text_bytes(part.column(2))):
                    words = terms_of(text)
                    if words:
                        count, within = held.setdefault((lang, source), (Counter(), Counter()))
                        count.update(words)
                        within.update(set(words))
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()
        B.release()

    parts = _groups(docs, lang_col, source_col, F.col(text_col).cast("string")).mapInArrow(
        tally, "lang string, source string, term string, c long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _groups(docs: DataFrame, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    named = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))
    return docs.select(*named, *more)


def _share(count: str | Column, total: str | Column, terms: str | Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly; null without terms."""
    count, total, terms = (F.col(c) if isinstance(c, str) else c for c in (count, total, terms))
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    whole = F.call_function("div", top, (total + SMOOTH * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + whole)


def _numbered(rows: DataFrame, key: str, of: str, block: str, place: str, n: str) -> DataFrame:
    """Deal the values of ``key`` in each language to ``n`` blocks and number them there, from 0."""
    dealt = rows.withColumn(block, F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
    return dealt.withColumn(place, F.row_number().over(W.partitionBy(of, block).orderBy(key)) - 1)


class Shares:
    """Kept terms and groups of a corpus, and the share of each kept term in each group that holds it.

    vocabulary: (lang, term, c, n, v, term_block, term_place) of the terms in
    ``min_docs`` documents of their language at least; groups: (lang, source, n, v,
    group_blocks, group_block, group_place, least); held: (lang, source, term, p, q,
    and the places), one row per group and kept term that occurs in it.
    """

    def __init__(self, docs: DataFrame, min_docs: int, lang_col: str = "lang", source_col: str = "source",
                 text_col: str = "text"):
        counts = cut_lineage(term_counts(docs, lang_col, source_col, text_col))
        kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
        kept = cut_lineage(kept.filter(F.col("d") >= min_docs).drop("d"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("n"))
        # salted: else all terms of a language would meet in one task, and stay there to be numbered
        blocks = salted_join(kept, langs, ["lang"], ["term"]).withColumn("_n", F.ceil(F.col("v") / TERM_BLOCK))
        self.vocabulary = cut_lineage(_numbered(blocks, "term", "lang", "term_block", "term_place", "_n").drop("_n"))
        own = counts.join(self.vocabulary.withColumn("q", _share("c", "n", "v")).drop("c", "n"), ["lang", "term"])
        own = own.select("lang", "source", "term", "c", "q", "term_block", "term_place")
        totals = own.groupBy("lang", "source").agg(F.sum("c").alias("n"))
        groups = _groups(docs, lang_col, source_col).distinct()
        sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUP_BLOCK).alias("group_blocks"))
        sizes = sizes.join(langs.select("lang", "v"), "lang", "left")
        groups = (salted_join(groups, sizes, ["lang"], ["source"])
                  .join(totals, ["lang", "source"], "left").fillna(0, ["v", "n"]))
        groups = _numbered(groups, "source", "lang", "group_block", "group_place", "group_blocks")
        self.groups = cut_lineage(groups.withColumn("least", _share(F.lit(0), "n", "v")))
        self.held = cut_lineage(own.join(self.groups.drop("group_blocks", "least"), ["lang", "source"])
                                .withColumn("p", _share("c", "n", "v")).drop("c", "n", "v"))


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of a cell from its two slices (one on the diagonal)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["group_block"])
    n = rows[0]["n_terms"]
    slices = []
    for r in rows:
        p = np.repeat(np.array([g["least"] or 0 for g in r["groups"]], np.int64)[:, None], n, axis=1)
        entries = r["entries"] or {"group_place": [], "term_place": [], "p": []}
        p[np.array(entries["group_place"], np.int64), np.array(entries["term_place"], np.int64)] = entries["p"]
        slices.append((np.array([g["source"] for g in r["groups"]], object), p))
    (left, p), (right, q) = slices[0], slices[-1]
    first, second, value = [], [], []
    for i in range(len(left)):
        j = i + 1 if len(rows) == 1 else 0
        far = np.abs(q[j:] - p[i]).sum(axis=1)
        others = right[j:]
        first += [left[i]] * len(others) + others.tolist()
        second += others.tolist() + [left[i]] * len(others)
        value += [far, far]
    return pa.table({"lang": pa.array([rows[0]["lang"]] * len(first), pa.string()), "source": pa.array(first, pa.string()),
                     "item": pa.array(second, pa.string()),
                     "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def pair_divergences(shares: Shares) -> DataFrame:
    """(lang, source, item, value): the sum of |p - q| over all kept terms, for every two sources of a language."""
    place = ["lang", "group_block", "term_block"]
    entries = shares.held.groupBy(*place).agg(F.collect_list(F.struct("group_place", "term_place", "p")).alias("_e"))
    entries = entries.select(*place, F.struct(*(F.col(f"_e.{c}").alias(c) for c in ("group_place", "term_place", "p"))).alias("entries"))
    groups = shares.groups.groupBy("lang", "group_block", "group_blocks").agg(
        F.sort_array(F.collect_list(F.struct("group_place", "source", "least"))).alias("groups"))
    terms = shares.vocabulary.groupBy("lang", "term_block").agg(F.count("*").cast("int").alias("n_terms"))
    slices = groups.join(terms, "lang", "left").fillna(0, ["term_block", "n_terms"]).join(entries, place, "left")
    cells = slices.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("group_blocks") - 1).cast("int"))))
    cells = cells.withColumns({"_a": F.least("group_block", "_other"), "_b": F.greatest("group_block", "_other")})
    partial = cells.groupBy("lang", "_a", "_b", "term_block").applyInArrow(
        _cell, "lang string, source string, item string, value long")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, lang_col: str = "lang",
                      source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair`` ranks the other sources of the language by divergence, the farthest
    first; part ``term`` has the ``top`` terms whose share in the group is furthest
    above that in the language. Ties go to the smaller item.
    """
    shares = Shares(docs, min_docs, lang_col, source_col, text_col)
    pairs = pair_divergences(shares).withColumn("part", F.lit("pair"))
    terms = shares.held.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [d.withColumn("rank", F.row_number().over(order)) for d in (pairs, terms)]
    out = ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
