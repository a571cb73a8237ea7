"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words. Documents are counted by source
and exact size; everything is decided on these counts, and documents are only
touched again when the chosen number of each (source, size) is marked in the
order of a seeded hash.

A source whose target is at least its size gives every document once (or twice,
at the limit); the rest of its target is a budget for one more take. The budget
is filled by the same share of every size, rounded along the sizes so that errors
cancel, up to ``SMALL`` words, and what then remains by bounded-knapsack dynamic
programming over the counts that are left.

Edge cases: a null text has size 0; a null source is a source of its own, last;
documents of size 0 are taken as often as the full passes of their source; rows
that repeat are separate documents; an empty table gives no rows. The result
depends on ids, texts and the seed only, not on partitioning. Extra columns of the
input are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regweave.session import cut_lineage

SMALL = 1 << 16
WEIGHTS = (5.0, 2.0, 1.0)
WORDS = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[tuple], weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target of each (source, size), in the order given: ``share`` of all words by weight.

    No target exceeds ``most`` times its source; the excess is dealt again by weight.
    """
    total = [float(s) for _, s in sizes]
    w = [weights[i % len(weights)] for i in range(len(total))]
    out = [0.0] * len(total)
    free, left = set(range(len(total))), share * sum(total)
    while free:
        unit = left / sum(w[i] for i in free)
        full = {i for i in free if w[i] * unit > most * total[i]}
        if not full:
            for i in free:
                out[i] = w[i] * unit
            break
        for i in full:
            out[i] = most * total[i]
            left -= out[i]
        free -= full
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sum is nearest ``budget`` from below.

    Lengths ascend and are positive. Binary parts of the bounded counts are
    added to a bit set of reachable sums until the budget itself is reached.
    """
    take = np.zeros(len(lengths), np.int64)
    for i in np.flatnonzero(lengths <= budget)[::-1]:  # longest first, until the bit set is small
        if budget <= SMALL:
            break
        take[i] = min(int(counts[i]), (budget - SMALL) // int(lengths[i]) + 1, budget // int(lengths[i]))
        budget -= int(take[i] * lengths[i])
    counts = counts - take
    if budget <= 0:
        return take
    mask, reached = (1 << (budget + 1)) - 1, [1]
    parts: list[tuple[int, int]] = []
    for i in np.flatnonzero(lengths <= budget)[::-1]:
        left, part = min(int(counts[i]), budget // int(lengths[i])), 1
        while left > 0 and not reached[-1] >> budget & 1:
            part_now = min(part, left)
            reached.append(reached[-1] | (reached[-1] << (part_now * int(lengths[i])) & mask))
            parts.append((int(i), part_now))
            left, part = left - part_now, part * 2
        if reached[-1] >> budget & 1:
            break
    at = reached[-1].bit_length() - 1
    for (i, n), before in zip(reversed(parts), reversed(reached[:-1])):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def _choose(target: float, source_size: int):
    """Full passes over a source, and the budget beyond them."""
    if source_size == 0:
        return 0, 0
    passes = int(target // source_size)
    return passes, int(round(target - passes * source_size))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Number of documents of each size that are taken once more than the full passes."""
    pdf = pdf.sort_values("size", ignore_index=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    passes, budget = _choose(float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0]))
    words = int((lengths * counts).sum())
    take = np.zeros(len(pdf), np.int64)
    if budget and words:
        share = max(0, budget - SMALL) / words
        take = np.diff(np.floor(np.cumsum(counts) * share), prepend=0).astype(np.int64)
        take[lengths == 0] = 0
        over = int((take * lengths).sum()) - budget
        for i in range(len(take) - 1, -1, -1):  # the largest first: one or two documents
            while over > 0 and take[i] > 0:
                take[i] -= 1
                over -= int(lengths[i])
        usable = lengths > 0
        take[usable] += fill(lengths[usable], (counts - take)[usable], -over)
    return pdf.assign(more=take, passes=passes)[["source", "size", "more", "passes"]]


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0,
                seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and times (how often the mix takes the document).

    Columns of ``docs`` that have one of these four names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col(id_col), text)
    clash = [c for c in ("size", "source_size", "target", "times") if c in docs.columns]
    keyed = docs.drop(*clash).withColumns({
        "size": F.regexp_count(text, F.lit(WORDS)).cast("long"),
        "__order": order, "__part": F.pmod(F.shiftright(order, 40), F.lit(1024)).cast("int"),
        "__source": F.col(source_col)})
    keys = cut_lineage(keyed.groupBy("__source", "size", "__part").agg(F.count("*").alias("n")))
    by_size = keys.groupBy(F.col("__source").alias("source"), "size").agg(F.sum("n").alias("n"))
    # one row a source
    sources = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()
    sources = sorted(((r[0], r[1]) for r in sources), key=lambda r: (r[0] is None, r[0] or ""))
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(s, n, t) for (s, n), t in zip(sources, targets(sources, weights, share, most))],
        "source string, source_size long, target double")
    counted = by_size.join(plan, by_size["source"].eqNullSafe(plan["source"])).select(
        by_size["source"], "size", "n", "source_size", "target")
    fitted = cut_lineage(counted.groupBy("source").applyInPandas(
        _fit, "source string, size long, more long, passes long"))
    # numbering of the documents of one (source, size), part by part
    before = Window.partitionBy("__source", "size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keys.withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    offsets = (offsets.join(fitted, F.col("__source").eqNullSafe(F.col("source")) & (offsets["size"] == fitted["size"]))
               .join(plan.withColumnRenamed("source", "__plan"), F.col("__source").eqNullSafe(F.col("__plan")))
               .select(F.col("__source").alias("__s"), offsets["size"].alias("__z"), F.col("__part").alias("__p"),
                       "__offset", F.col("more").alias("__more"), F.col("passes").alias("__passes"), "source_size", "target"))
    # parts wholly taken or wholly left need no numbering, but numbering them is cheap
    joined = keyed.join(offsets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
                        & (F.col("__part") == F.col("__p")))
    rank = F.row_number().over(Window.partitionBy("__s", "__z", "__p").orderBy("__order", F.col(id_col)))
    return (joined.withColumn("times", F.col("__passes") + (rank + F.col("__offset") <= F.col("__more")).cast("long"))
            .drop("__s", "__z", "__p", "__offset", "__order", "__part", "__source", "__more", "__passes"))
