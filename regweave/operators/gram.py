"""Sufficient statistics of every per-target regression in one aggregation.

Design rows are ``(target, cell, j, v, w)``: one row per non-zero design value,
with ``j = 0`` for the intercept, ``1..p`` for terms and ``-1`` for the
response. Rows are spread over (target, salt of cell); each task multiplies
blocks of cells and sends on at most one partial sum per matrix entry, which
Spark then adds up. No target's cells x terms matrix exists in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.functions.columns import salt_of
from regweave.operators.packed import INTERCEPT, RESPONSE, Design, bag_weights, grams
from regweave.session import cut_lineage

_BLOCK_CELLS = 4_000_000     # dense entries per multiplied block
_BAGS_PER_PASS = 50          # replicates accumulated together in a task


class _Block:
    """Running weighted cross-products of one target inside one task."""

    def __init__(self, target, intercept: bool, bags: int, seed: int, first: int):
        self.target, self.intercept, self.bags, self.seed = target, intercept, bags, seed
        self.first = first
        self.labels = pd.Index([INTERCEPT] if intercept else [], dtype="object")
        self.g = np.zeros((max(bags, 1), len(self.labels), len(self.labels)))

    def add(self, cell: np.ndarray, j: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        new = pd.unique(pd.Series(j)[self.labels.get_indexer(j) < 0])
        if len(new):
            old, self.labels = len(self.labels), self.labels.append(pd.Index(new, dtype="object"))
            g = np.zeros((self.g.shape[0], len(self.labels), len(self.labels)))
            g[:, :old, :old] = self.g
            self.g = g
        col = self.labels.get_indexer(j)
        row, cells = pd.factorize(cell)
        step = max(1, _BLOCK_CELLS // max(1, len(self.labels)))
        order = np.argsort(row, kind="stable")
        row, col, v, w = row[order], col[order], v[order], w[order]
        for lo in range(0, len(cells), step):
            a, b = np.searchsorted(row, [lo, lo + step])
            n = min(step, len(cells) - lo)
            m = np.zeros((n, len(self.labels)))
            np.add.at(m, (row[a:b] - lo, col[a:b]), v[a:b])
            if self.intercept:
                m[:, 0] = 1.0
            cw = np.ones(n)
            cw[row[a:b] - lo] = w[a:b]
            if self.bags == 0:
                self.g[0] += m.T @ (m * cw[:, None])
                continue
            h = np.asarray(cells[lo:lo + n])
            for k in range(self.bags):
                self.g[k] += m.T @ (m * (cw * bag_weights(h, self.first + k, self.seed))[:, None])

    def rows(self) -> pd.DataFrame:
        iu, ju = np.triu_indices(len(self.labels))
        s = self.g[:, iu, ju]
        rep, pos = np.nonzero(s)
        labels = self.labels.to_numpy()
        a, b = labels[iu[pos]], labels[ju[pos]]
        swap = np.array([x > y for x, y in zip(a, b)], dtype=bool)
        return pd.DataFrame({"target": self.target, "rep": (rep + self.first).astype("int32"),
                             "i": np.where(swap, b, a), "j": np.where(swap, a, b),
                             "s": s[rep, pos]})


def _partials(intercept: bool, bags: int, seed: int, first: int = 0):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            last = (pdf["target"] == pdf["target"].iloc[-1]) & (pdf["cell"] == pdf["cell"].iloc[-1])
            held, pdf = pdf[last], pdf[~last]
            for part in _runs(pdf):
                if block is None or block.target != part["target"].iloc[0]:
                    if block is not None:
                        yield block.rows()
                    block = _Block(part["target"].iloc[0], intercept, bags, seed, first)
                _feed(block, part, bags)
        if held is not None and len(held):
            if block is None or block.target != held["target"].iloc[0]:
                if block is not None:
                    yield block.rows()
                block = _Block(held["target"].iloc[0], intercept, bags, seed, first)
            _feed(block, held, bags)
        if block is not None:
            yield block.rows()
    return run


def _feed(block: _Block, part: pd.DataFrame, bags: int) -> None:
    cell = part["h"] if bags else part["cell"]
    block.add(cell.to_numpy(), part["j"].to_numpy(), part["v"].to_numpy(), part["w"].to_numpy())


def _runs(pdf: pd.DataFrame):
    t = pdf["target"].to_numpy()
    cut = np.flatnonzero(t[1:] != t[:-1]) + 1 if len(t) else []
    edges = [0, *cut, len(t)] if len(t) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield pdf.iloc[a:b]


def spread_design(design: DataFrame, salt: int = 16) -> DataFrame:
    """Co-locate rows of one (target, cell) and split every target over ``salt`` tasks."""
    return (design.withColumn("salt", salt_of("cell", buckets=salt))
            .repartition("target", "salt").sortWithinPartitions("target", "cell"))


def gram_sums(design: DataFrame | Design, intercept: bool = True, bags: int = 0, seed: int = 1,
              salt: int = 16) -> DataFrame:
    """``(target[, rep], i, j, s)`` with ``i <= j``.

    With ``bags`` every replicate reweights cells by Poisson(1) draws derived
    from the cell's hash. The (0, 0) entry only counts cells with stored values;
    use the observation count instead. A :class:`Design` is multiplied without
    its rows.
    """
    if isinstance(design, Design):
        g = grams(design, bags=bags, seed=seed)
        return g if bags else g.drop("rep")
    cols = ["target", "cell", "j", "v", "w"]
    if "w" not in design.columns:
        design = design.withColumn("w", F.lit(1.0))
    rows = spread_design(design.select(*cols), salt)
    if bags:
        rows = rows.withColumn("h", F.xxhash64("cell"))
        cols = [*cols, "h"]
    ttype = design.schema["target"].dataType.simpleString()
    jtype = design.schema["j"].dataType.simpleString()
    schema = f"target {ttype}, rep int, i {jtype}, j {jtype}, s double"
    rows = rows.select(*cols)
    if bags > _BAGS_PER_PASS:
        # Several passes bound a task's memory; a checkpoint keeps cells together.
        rows = cut_lineage(rows, keep_layout=True)
    part = None
    for first in range(0, max(bags, 1), _BAGS_PER_PASS):
        n = min(_BAGS_PER_PASS, bags - first) if bags else 0
        one = rows.mapInPandas(_partials(intercept, n, seed, first), schema)
        part = one if part is None else part.unionByName(one)
    keys = ["target", "rep", "i", "j"] if bags else ["target", "i", "j"]
    return part.groupBy(*keys).agg(F.sum("s").alias("s"))


def gram_by_fold(design: DataFrame | Design, folds: int, seed: int = 1, salt: int = 16) -> DataFrame:
    """One Gram per target and fold, the fold being a hash of the cell."""
    if isinstance(design, Design):
        return grams(design, folds=folds, seed=seed).withColumnRenamed("rep", "fold")
    fold = F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(folds)).cast("int")
    ttype = design.schema["target"].dataType
    keyed = design.withColumn("target", F.struct(F.col("target").alias("t"), fold.alias("f")))
    # A plain string key keeps the worker code unaware of folds.
    keyed = keyed.withColumn("target", F.concat_ws(
        "\u0001", F.col("target.t").cast("string"), F.col("target.f").cast("string")))
    g = gram_sums(keyed, salt=salt)
    parts = F.split("target", "\u0001")
    return g.select(parts[0].cast(ttype).alias("target"), parts[1].cast("int").alias("fold"),
                    "i", "j", "s")


def bag_totals(cells: DataFrame, bags: int, seed: int) -> DataFrame:
    """``(rep, n)``: total replicate weight over all cells."""
    def run(batches):
        tot = np.zeros(bags)
        for pdf in batches:
            h, w = pdf["h"].to_numpy(), pdf["w"].to_numpy()
            for k in range(bags):
                tot[k] += float((bag_weights(h, k, seed) * w).sum())
        yield pd.DataFrame({"rep": np.arange(bags, dtype="int32"), "n": tot})
    w = F.col("weight").cast("double") if "weight" in cells.columns else F.lit(1.0)
    src = cells.select(F.xxhash64("cell").alias("h"), w.alias("w"))
    return src.mapInPandas(run, "rep int, n double").groupBy("rep").agg(F.sum("n").alias("n"))
