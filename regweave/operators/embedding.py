"""Principal components of a sparse gene matrix, kept distributed.

Block power iteration: the tall matrix and the factor tables stay DataFrames;
only k x k inner products reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators.skew import salted_join
from regweave.session import cut_lineage


_ALL = 32      # up to so many directions all are carried, which is exact at once


def _cols(p: str, k: int) -> list[str]:
    return [f"{p}{i}" for i in range(k)]


def _combine(df: DataFrame, names: list[str], m: np.ndarray, out: list[str], key: str):
    """Right-multiply the factor columns by a small matrix."""
    exprs = []
    for c in range(m.shape[1]):
        e = F.lit(0.0)
        for r, n in enumerate(names):
            e = e + F.col(n) * F.lit(float(m[r, c]))
        exprs.append(e.alias(out[c]))
    return df.select(key, *exprs)


def _inner(df: DataFrame, names: list[str]) -> np.ndarray:
    k = len(names)
    row = df.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}")
                   for i in range(k) for j in range(i, k)]).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def _orthonormal(df: DataFrame, names: list[str], key: str) -> tuple[DataFrame, np.ndarray]:
    ev, vec = np.linalg.eigh(_inner(df, names))
    order = np.argsort(ev)[::-1]
    ev, vec = np.maximum(ev[order], 0.0), vec[:, order]
    good = ev > 1e-12 * max(ev[0], 1e-300)
    scale = np.where(good, 1.0 / np.sqrt(np.where(good, ev, 1.0)), 0.0)
    return _combine(df, names, vec * scale, names, key), ev


def principal_components(matrix: DataFrame, n_pcs: int = 30, max_iterations: int = 300,
                         tol: float = 1e-10, extra: int = 10, seed: int = 111) -> DataFrame:
    """``(gene, pc_1..pc_k)`` scores of ``matrix(gene, col, value)``, columns centred.

    Absent entries are zeros; centring is applied to the products, so the matrix
    stays sparse. The iteration carries at least ``extra`` directions more than
    asked for (all of them where there are few) and ends when the eigenvalues
    asked for move by less than ``tol``; it is an error if they still do after
    ``max_iterations``. The sign of a component makes its largest sum positive.
    Without any direction, as of an empty matrix or a single gene, all scores are 0.
    """
    m = cut_lineage(matrix.select("gene", "col", F.col("value").cast("double").alias("value")))
    genes = cut_lineage(m.select("gene").distinct())
    n = genes.count()
    means = cut_lineage(m.groupBy("col").agg((F.sum("value") / F.lit(float(n))).alias("mu")))
    rank = min(n - 1, means.count())
    if rank < 1:
        return genes.select("gene", *[F.lit(0.0).alias(f"pc_{i + 1}") for i in range(n_pcs)])
    wanted = min(n_pcs, rank)
    k = rank if rank <= _ALL else min(wanted + extra, rank)
    q, y = _cols("q", k), _cols("y", k)

    def unit(i):
        h = F.pmod(F.xxhash64("col", F.lit(seed), F.lit(i)), F.lit(1_000_003))
        return (h / F.lit(1_000_003.0) - F.lit(0.5)).alias(q[i])
    right = means.select("col", *[unit(i) for i in range(k)])
    right, _ = _orthonormal(cut_lineage(right), q, "col")
    last, done = None, False
    for it in range(max_iterations + 1):
        shift = means.join(right, "col").agg(
            *[F.sum(F.col("mu") * F.col(c)).alias(c) for c in q]).first()
        left = (salted_join(m, right, ["col"], ["gene"]).groupBy("gene")
                .agg(*[F.sum(F.col("value") * F.col(a)).alias(b) for a, b in zip(q, y)]))
        left = cut_lineage(left.select(
            "gene", *[(F.col(b) - F.lit(float(shift[a] or 0.0))).alias(b) for a, b in zip(q, y)]))
        if done:
            break
        tot = left.agg(*[F.sum(c).alias(c) for c in y]).first()
        new = (salted_join(m, left, ["gene"], ["col"]).groupBy("col")
               .agg(*[F.sum(F.col("value") * F.col(b)).alias(a) for a, b in zip(q, y)]))
        new = means.join(new, "col").select("col", *[
            (F.col(a) - F.col("mu") * F.lit(float(tot[b] or 0.0))).alias(a)
            for a, b in zip(q, y)])
        right, ev = _orthonormal(cut_lineage(new), q, "col")
        now = np.sqrt(ev[:wanted])
        done = last is not None and bool(np.all(np.abs(now - last) <= tol * max(now[0], 1e-300)))
        last = now
    else:
        raise ValueError("principal components did not converge")
    # Rotate scores so that components are uncorrelated and sorted by variance.
    ev, vec = np.linalg.eigh(_inner(left, y))
    vec = vec[:, np.argsort(ev)[::-1][:wanted]]
    names = [f"pc_{i + 1}" for i in range(wanted)]
    pcs = _combine(left, y, vec, names, "gene")
    cubes = pcs.agg(*[F.sum(F.pow(F.col(c), F.lit(3.0))).alias(c) for c in names]).first()
    return pcs.select("gene", *[
        (F.col(c) * F.lit(-1.0 if (cubes[c] or 0.0) < 0 else 1.0)).alias(c) for c in names])


def weighted_coexpression(corr: DataFrame, modules: DataFrame) -> DataFrame:
    """``cor * sqrt(|estimate| + 1)`` over all target x tf entries; no edge means 0.

    ``corr(target, tf, corr)`` lists the wanted entries.
    """
    m = modules.select("target", "tf", "estimate")
    e = F.coalesce("estimate", F.lit(0.0))
    return (corr.join(m, ["target", "tf"], "left")
            .select("target", "tf", (F.col("corr") * F.sqrt(F.abs(e) + 1)).alias("coex")))


def target_tf_matrix(modules: DataFrame, tfs: list) -> DataFrame:
    """Wide targets x TFs table of estimates, 0 where there is no edge."""
    wide = modules.groupBy("target").pivot("tf", tfs).agg(F.first("estimate"))
    return wide.fillna(0.0, [str(t) for t in tfs])


def motif_tf_matrix(motif_tf: DataFrame, tfs: list) -> DataFrame:
    """Wide motifs x TFs incidence."""
    wide = (motif_tf.select("motif", "tf").distinct().groupBy("motif").pivot("tf", tfs)
            .agg(F.count(F.lit(1))))
    return wide.fillna(0, [str(t) for t in tfs])


def to_long(wide: DataFrame, id_col: str, name: str = "target", value: str = "corr") -> DataFrame:
    cols = [c for c in wide.columns if c != id_col]
    return wide.unpivot([id_col], cols, name, value)
