"""Gradient-boosted trees, one model per target.

Spark bins the terms and brings the rows of a target together: one row per (target,
cell) with the stored terms as small arrays, and one weighted row for the cells
without stored values. Trees grow on histograms over (node, term, bin); zeros are
never stored, their share is the node total minus the stored bins, and of two
siblings only the smaller is counted, the other is the rest of the parent.

A target of at most ``HELD`` stored terms is fitted by one task. The rows of a larger
one are dealt by cell to all tasks of a barrier stage; after each level the tasks
exchange the histograms of what they hold, add them in the same order and so grow the
same tree. Large targets go in slices that bound what a task holds and sends.
A lost executor restarts its group's fit, or its slice.
"""

from __future__ import annotations

import base64
from collections.abc import Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators.correlation import observation_count
from regweave.operators.gram import RESPONSE
from regweave.operators.skew import salted_join
from regweave.session import cut_lineage

#: Stored terms that one task holds, and bytes of histograms that it sends at once.
HELD = 8_000_000
SENT = 4 << 20
RESULT = "target string, j int, gain double, cover double, frequency double, rsq double"


def _binned(design: DataFrame, bins: int) -> DataFrame:
    """Add ``bin``: values of a term are cut at approximate quantiles.

    Bin numbers order the values; zero is bin 0, positive values are above.
    """
    x = design.filter("j > 0")
    cuts = (x.groupBy("target", "j").agg(F.percentile_approx(
        "v", F.array(*[F.lit((k + 1) / bins) for k in range(bins)]), 10_000).alias("cuts"))
        .withColumn("cuts", F.array_distinct("cuts")))
    b = salted_join(x, cuts, ["target", "j"], ["cell"])
    above = F.size(F.filter("cuts", lambda c: (c < F.col("v")) & (c >= 0)))
    below = F.size(F.filter("cuts", lambda c: (c >= F.col("v")) & (c < 0)))
    return b.withColumn("bin", F.when(F.col("v") > 0, above + 1).otherwise(-below - 1))


def _rows(design: DataFrame, obs: DataFrame, bins: int, zero: DataFrame | None = None) -> DataFrame:
    """``(target, cell, y, w, js, bins)``: terms and bins of the stored values.

    ``zero(target, zero)`` is the response of cells where none is stored, else 0.
    """
    feats = (_binned(design, bins).groupBy("target", "cell").agg(
        F.collect_list(F.struct("j", "bin")).alias("x")))      # bounded by the term count
    y = design.filter(F.col("j") == RESPONSE).select("target", "cell", F.col("v").alias("y"))
    w = design.groupBy("target", "cell").agg(F.first("w").alias("w"))
    rows = w.join(feats, ["target", "cell"], "left").join(y, ["target", "cell"], "left")
    rows = rows.withColumn("zero", F.lit(0.0)) if zero is None else rows.join(zero, "target")
    rows = (rows.select("target", "cell", F.coalesce("y", "zero").alias("y"), "w", "zero",
                    F.transform("x", lambda s: s["j"]).alias("js"),
                    F.transform("x", lambda s: s["bin"]).alias("bins")))
    ctype = design.schema["cell"].dataType
    rest = (rows.groupBy("target").agg(F.sum("w").alias("sw"), F.first("zero").alias("zero"))
            .withColumn("w", observation_count(obs) - F.col("sw")).filter("w > 0")
            .select("target", F.lit(None).cast(ctype).alias("cell"), F.col("zero").alias("y"), "w",
                    F.lit(None).cast("array<int>").alias("js"),
                    F.lit(None).cast("array<int>").alias("bins")))
    return rows.drop("zero").unionByName(rest)


class Options(NamedTuple):
    """How trees are grown. ``objective`` is gaussian, poisson or binomial."""

    max_depth: int = 3
    eta: float = 0.01
    nrounds: int = 1000
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    base_score: float = 0.5
    bins: int = 64
    objective: str = "gaussian"

    def start(self) -> float:
        """The first score of a row: the base score on the scale of the link."""
        return {"gaussian": self.base_score, "poisson": float(np.log(self.base_score)),
                "binomial": float(np.log(self.base_score / (1 - self.base_score)))}[self.objective]

    def mean(self, f: np.ndarray) -> np.ndarray:
        if self.objective == "gaussian":
            return f
        return np.exp(f) if self.objective == "poisson" else 1 / (1 + np.exp(-f))

    def slopes(self, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log likelihood of each row."""
        mu = self.mean(f)
        curve = {"gaussian": np.ones_like(mu), "poisson": mu * np.exp(0.7), "binomial": mu * (1 - mu)}
        return y - mu, curve[self.objective]


class Held:
    """The rows of a target that one task holds, and their stored bins by term."""

    def __init__(self, table: pa.Table, terms: np.ndarray, bins: int):
        self.y, self.w = (table[c].to_numpy().astype(np.float64) for c in ("y", "w"))
        js, own = (table[c].combine_chunks() for c in ("js", "bins"))
        counts = np.nan_to_num(js.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        term = np.searchsorted(terms, js.flatten().to_numpy(zero_copy_only=False))
        self.width, self.n_terms = 2 * bins + 1, len(terms)
        place = term * self.width + own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + bins
        order = np.argsort(place, kind="stable")      # the values of a place lie side by side
        self.row = np.repeat(np.arange(len(self.y)), counts)[order]
        place = place[order]
        self.begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][:len(place)])
        self.places, self.bins, self.weights = place[self.begins], bins, None

    def histograms(self, slot: np.ndarray, n: int, values: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(slot, value, place) sums of the rows in each slot (below 0: in none); the last place has the total."""
        out = np.zeros((n, 2, self.n_terms * self.width + 1))
        for i in range(n):
            inside = slot == i
            if values[1] is self.w and inside.all():      # the same weights in every round
                if self.weights is None:
                    self.weights = self._sums(self.w)
                out[i] = self._sums(values[0]), self.weights
            else:
                both = np.zeros(len(slot), complex)
                both.real[inside], both.imag[inside] = values[0][inside], values[1][inside]
                both = self._sums(both)
                out[i] = both.real, both.imag
        return out

    def _sums(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_terms * self.width + 1, v.dtype)
        if len(self.row):
            out[self.places] = np.add.reduceat(v[self.row], self.begins)
        out[-1] = v.sum()
        return out

    def goes_left(self, node: np.ndarray, of: int, term: int, cut: int) -> np.ndarray:
        """Rows of node ``of`` whose bin of ``term`` is ``cut`` at most."""
        left = np.full(len(node), cut >= 0)
        first = term * self.width
        lo, mid, hi = (self._upto(x) for x in (first, first + cut + self.bins + 1, first + self.width))
        left[self.row[lo:mid]], left[self.row[mid:hi]] = True, False
        return left & (node == of)

    def _upto(self, place: int) -> int:
        """How many stored values lie in the places below ``place``."""
        at = int(np.searchsorted(self.places, place))
        return int(self.begins[at]) if at < len(self.begins) else len(self.row)


def best_split(hist: np.ndarray, n_terms: int, o: Options) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, term, last bin to the left, (g, h) to the left) of a node; ties go to the smaller term and bin."""
    total = hist[:, -1]
    cells = hist[:, :-1].reshape(2, n_terms, -1).copy()
    cells[:, :, o.bins] += total[:, None] - cells.sum(axis=2)
    (gl, hl), (gt, ht) = np.cumsum(cells, axis=2), total
    gr, hr = gt - gl, ht - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + o.reg_lambda) + gr * gr / (hr + o.reg_lambda) - gt * gt / (ht + o.reg_lambda)
    gain = np.where((hl >= o.min_child_weight) & (hr >= o.min_child_weight) & np.isfinite(gain), gain, -np.inf)
    if not gain.size:
        return None
    term, place = divmod(int(np.argmax(np.round(gain, 9))), gain.shape[1])
    best = float(gain[term, place])
    return (best, term, place - o.bins, np.array([gl[term, place], hl[term, place]])) if best > 1e-9 else None


def grow(held: Held, o: Options) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Grow all trees; yields sums over the rows held and is sent those over all rows.

    Returns (gain, cover, frequency) by term, and (rss, yy, sy, n) of the fit.
    """
    f, importance = np.full(len(held.y), o.start()), np.zeros((3, held.n_terms))
    for _ in range(o.nrounds):
        slope, curve = o.slopes(held.y, f)
        values = (held.w * slope, held.w if o.objective == "gaussian" else held.w * curve)
        node, step = np.zeros(len(f), np.int64), np.zeros(len(f))
        hists = list((yield held.histograms(node, 1, values)))
        for depth in range(1, o.max_depth + 1):
            parents, slot, after = [], np.full(len(f), -1), np.full(len(f), -1)
            for k, hist in enumerate(hists):
                split = best_split(hist, held.n_terms, o)
                if split is None:
                    g, h = hist[:, -1]
                    step[node == k] = o.eta * g / (h + o.reg_lambda)
                    continue
                gain, term, cut, left = split
                importance[:, term] += gain, hist[1, -1], 1
                goes, here, n = held.goes_left(node, k, term, cut), node == k, len(parents)
                after[here] = 2 * n + 1
                after[goes] = 2 * n
                small = goes if left[1] <= hist[1, -1] - left[1] else here & ~goes
                slot[small] = n
                parents.append((hist, left, bool(left[1] <= hist[1, -1] - left[1])))
                if depth == o.max_depth:
                    for (g, h), rows in ((left, goes), (hist[:, -1] - left, here & ~goes)):
                        step[rows] = o.eta * g / (h + o.reg_lambda)
            if depth == o.max_depth or not parents:
                break
            smaller, hists, node = (yield held.histograms(slot, len(parents), values)), [], after
            for (hist, _, first), own in zip(parents, smaller):
                hists += [own, hist - own] if first else [hist - own, own]
        f += step
    left = held.w * (held.y - o.mean(f)) ** 2
    sums = yield np.array([left.sum(), (held.w * held.y ** 2).sum(), (held.w * held.y).sum(), held.w.sum()])
    return importance, sums


def _alone(growing: Generator) -> tuple[np.ndarray, np.ndarray]:
    sums = next(growing)
    while True:
        try:
            sums = growing.send(sums)
        except StopIteration as done:
            return done.value


def _together(growing: list[Generator], exchange) -> list[tuple[np.ndarray, np.ndarray]]:
    """Drive the fits in step, with one exchange for all of them."""
    sums, results = {i: next(g) for i, g in enumerate(growing)}, {}
    while sums:
        flat = exchange(np.concatenate([x.ravel() for x in sums.values()]))
        cuts = np.cumsum([x.size for x in sums.values()])[:-1]
        told, sums = {i: t.reshape(x.shape) for (i, x), t in zip(sums.items(), np.split(flat, cuts))}, {}
        for i, t in told.items():
            try:
                sums[i] = growing[i].send(t)
            except StopIteration as done:
                results[i] = done.value
    return [results[i] for i in range(len(growing))]


def _report(target: str, terms: np.ndarray, result: tuple[np.ndarray, np.ndarray]) -> list[dict]:
    """Shares of the importance of each term used, and R2 under j = -1."""
    importance, (rss, yy, sy, n) = result
    used = np.flatnonzero(importance[2])
    shares = importance[:, used] / importance[:, used].sum(axis=1, keepdims=True) if len(used) else importance[:, used]
    around = yy - sy * sy / n if n else 0.0
    rows = [{"target": target, "j": int(j), "gain": a, "cover": b, "frequency": c, "rsq": None}
            for j, a, b, c in zip(terms[used], *shares.tolist())]
    return [*rows, {"target": target, "j": -1, "gain": None, "cover": None, "frequency": None,
                    "rsq": 1 - rss / around if around else None}]


_ARROW = pa.schema([("target", pa.string()), ("j", pa.int32()), ("gain", pa.float64()), ("cover", pa.float64()),
                    ("frequency", pa.float64()), ("rsq", pa.float64())])


def _fit_small(rows: DataFrame, o: Options) -> DataFrame:
    def fit(table: pa.Table) -> pa.Table:
        terms = np.unique(table["js"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        found = _alone(grow(Held(table.select(["y", "w", "js", "bins"]), terms, o.bins), o))
        return pa.Table.from_pylist(_report(table["target"][0].as_py(), terms, found), _ARROW)
    return rows.groupBy("target").applyInArrow(fit, RESULT)


def _fit_slice(rows: DataFrame, targets: list[tuple[str, list[int]]], o: Options, tasks: int) -> DataFrame:
    """Fit some large targets in one barrier stage; every task holds the rows of some cells."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, got = BarrierTaskContext.get(), list(batches)
        names = ["target", "y", "w", "js", "bins"]
        table = pa.Table.from_batches(got) if got else pa.table(
            {"target": pa.array([], pa.string()), "y": pa.array([], pa.float64()), "w": pa.array([], pa.float64()),
             "js": pa.array([], pa.list_(pa.int32())), "bins": pa.array([], pa.list_(pa.int32()))})

        def exchange(own: np.ndarray) -> np.ndarray:
            out = np.zeros(len(own))
            for message in context.allGather(base64.b64encode(own.tobytes()).decode()):
                out += np.frombuffer(base64.b64decode(message))
            return out

        growing = [grow(Held(table.select(names).filter(pc.equal(table["target"], t)), np.array(j), o.bins), o)
                   for t, j in targets]
        found = _together(growing, exchange)
        if context.partitionId() == 0:  # all tasks have the same result
            for (t, j), result in zip(targets, found):
                yield from pa.Table.from_pylist(_report(t, np.array(j), result), _ARROW).to_batches()

    mine = rows.filter(F.col("target").isin([t for t, _ in targets])).select("target", "y", "w", "js", "bins", "cell")
    return mine.repartition(tasks, "cell").drop("cell").mapInArrow(fit, RESULT, barrier=True)


def _slices(large: list[tuple[str, list[int], int]], o: Options, tasks: int) -> Iterator[list[tuple[str, list[int]]]]:
    """Consecutive targets that together stay below ``HELD`` per task and ``SENT``, one at least."""
    part, held, sent = [], 0, 0
    for target, terms, n in large:
        size = 16 * (len(terms) * (2 * o.bins + 1) + 1) * 2 ** max(0, o.max_depth - 2)
        if part and (held + n > HELD * tasks or sent + size > SENT):
            yield part
            part, held, sent = [], 0, 0
        part, held, sent = [*part, (target, terms)], held + n, sent + size
    if part:
        yield part


def fit_boosting(design: DataFrame, obs: DataFrame, max_depth: int = 3, eta: float = 0.01,
                 nrounds: int = 1000, reg_lambda: float = 1.0, min_child_weight: float = 1.0,
                 base_score: float = 0.5, bins: int = 64, objective: str = "gaussian",
                 zero: DataFrame | None = None) -> DataFrame:
    """Importance ``gain, cover, frequency`` per term (shares of the target's
    total) and training R2, in the common solution layout.

    ``objective`` is gaussian, poisson or binomial; the response of the last lies in
    0..1. ``zero(target, zero)`` is the response of cells where none is stored, 0 if
    not given. Of the large targets the driver holds names and terms, not rows.
    """
    from regweave.operators.models import _superset
    if objective not in ("gaussian", "poisson", "binomial"):
        raise ValueError("objective must be gaussian, poisson or binomial")
    o = Options(max_depth, eta, nrounds, reg_lambda, min_child_weight, base_score, bins, objective)
    rows = cut_lineage(_rows(design, obs, bins, zero))
    sizes = rows.groupBy("target").agg(F.sum(F.greatest(F.size("js"), F.lit(1))).alias("n")).filter(F.col("n") > HELD)
    names = [(r.target, r.n) for r in sizes.orderBy("target").collect()]
    out = _fit_small(rows.filter(~F.col("target").isin([t for t, _ in names])) if names else rows, o)
    if names:
        terms = {r.target: sorted(r.js) for r in rows.filter(F.col("target").isin([t for t, _ in names])).select(
            "target", F.explode("js").alias("j")).groupBy("target").agg(F.collect_set("j").alias("js")).collect()}
        tasks = max(2, rows.sparkSession.sparkContext.defaultParallelism)
        for part in _slices([(t, terms.get(t, []), n) for t, n in names], o, tasks):
            out = out.unionByName(cut_lineage(_fit_slice(rows, part, o, tasks)))
    return _superset(out, extra=("gain", "cover", "frequency"))
