"""Generalised linear models: one weighted Gram per iteration for all targets.

Each pass brings the current coefficients to the cells, computes working
weights and responses per block of cells inside the tasks and adds up weighted
cross-products. The blocks are slices of stored values, written once, from which
the tasks form the design, so its rows are never shuffled or written; designs
that are given as rows are spread once. Cells without any stored value share one
linear predictor, so they enter as ``count x constant`` in the per-target solve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regweave.functions.columns import all_salts
from regweave.functions.solvers import independent_columns, lambda_path
from regweave.functions.tails import normal_two_sided, student_two_sided
from regweave.operators.correlation import observation_count
from regweave.operators.gram import RESPONSE, spread_design
from regweave.operators.packed import Design, Slices, grams
from regweave.operators.skew import salted_join
from regweave.session import cut_lineage, discard

#: Families with their usual links; those of ``_DISPERSED`` have an estimated dispersion and t statistics.
FAMILIES = {"poisson": "log", "binomial": "logit", "quasipoisson": "log", "quasibinomial": "logit",
            "Gamma": "inverse", "inverse.gaussian": "1/mu^2"}
_DISPERSED = ("quasipoisson", "quasibinomial", "Gamma", "inverse.gaussian")
_DEVIANCE, _CELLS, _PEARSON = -3, -4, -5      # labels of the entries beside the Gram
_SALT = 16
_BLOCK_ENTRIES = 4_000_000


class Family:
    """Mean, variance and deviance of a response, and the link to the linear predictor."""

    def __init__(self, name: str, link: str | None = None):
        if name not in FAMILIES:
            raise ValueError(f"family must be gaussian or one of {tuple(FAMILIES)}")
        self.name, self.kind = name, name.removeprefix("quasi")
        self.link, self.dispersed = link or FAMILIES[name], name in _DISPERSED
        if self.link not in ("log", "logit", "identity", "inverse", "1/mu^2"):
            raise ValueError("link must be log, logit, identity, inverse or 1/mu^2")
        #: Responses of zero, which are not stored, have no place in a positive family.
        self.positive = self.kind in ("Gamma", "inverse.gaussian")

    def mean(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and its slope along the linear predictor."""
        if self.link == "log":
            mu = np.exp(np.clip(eta, -30, 30))
            return mu, mu
        if self.link == "logit":
            mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -30, 30)))
            return mu, np.maximum(mu * (1 - mu), 1e-10)
        if self.link == "identity":
            return eta, np.ones_like(eta)
        if self.link == "inverse":
            return 1 / eta, -1 / eta**2
        return 1 / np.sqrt(eta), -0.5 * eta**-1.5

    def valid(self, eta: np.ndarray) -> bool:
        """Whether all predictors have a mean that the family can take."""
        if not np.isfinite(eta).all() or self.link == "inverse" and (eta == 0).any():
            return False
        if self.link == "1/mu^2" and (eta <= 0).any():
            return False
        mu, _ = self.mean(eta)
        return bool((mu > 0).all()) and (self.kind != "binomial" or bool((mu < 1).all()))

    def variance(self, mu: np.ndarray) -> np.ndarray:
        v = {"poisson": lambda: mu, "binomial": lambda: mu * (1 - mu), "Gamma": lambda: mu**2,
             "inverse.gaussian": lambda: mu**3}[self.kind]()
        return np.maximum(v, 1e-10)

    def start(self, y: np.ndarray) -> np.ndarray:
        mu = {"poisson": lambda: y + 0.1, "binomial": lambda: (y + 0.5) / 2.0}.get(self.kind, lambda: y)()
        return {"log": lambda: np.log(mu), "logit": lambda: np.log(mu / (1.0 - mu)), "identity": lambda: mu,
                "inverse": lambda: 1 / mu, "1/mu^2": lambda: mu**-2.0}[self.link]()

    def working(self, eta: np.ndarray, y: np.ndarray):
        """Working weights and responses, and the means."""
        mu, slope = self.mean(eta)
        return np.maximum(slope**2 / self.variance(mu), 1e-10), eta + (y - mu) / slope, mu

    def deviance(self, y: np.ndarray, mu: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.kind == "Gamma":
                return 2.0 * ((y - mu) / mu - np.log(y / mu))
            if self.kind == "inverse.gaussian":
                return (y - mu) ** 2 / (y * mu**2)
            part = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
            if self.kind == "poisson":
                return 2.0 * (part - (y - mu))
            rest = np.where(y < 1, (1 - y) * np.log(np.where(y < 1, 1 - y, 1.0)
                                                    / np.maximum(1 - mu, 1e-300)), 0.0)
            return 2.0 * (part + rest)

    def outside(self, y: Column) -> Column:
        """Whether a response is none of the family."""
        if self.positive:
            return y <= 0
        return y < 0 if self.kind == "poisson" else (y < 0) | (y > 1)

    def null_deviance(self) -> tuple[Column, Column]:
        """Of the intercept-only model: what is summed over ``v``, and the deviance from
        that sum ``sl``, the responses' ``s1`` and the count ``n``."""
        v, m, s1, sl, n = F.col("v"), F.col("s1") / F.col("n"), F.col("s1"), F.col("sl"), F.col("n")

        def entropy(x):
            return F.when(x > 0, x * F.log(x)).otherwise(0.0)
        if self.kind == "poisson":
            return entropy(v), 2 * (sl - s1 * F.log(m))
        if self.kind == "binomial":
            return entropy(v) + entropy(1 - v), 2 * (sl - s1 * F.log(m) - (n - s1) * F.log(1 - m))
        if self.kind == "Gamma":
            return F.log(v), 2 * (n * F.log(m) - sl)
        return 1 / v, sl - n / m


def _weighted(family: Family, names: np.ndarray, m: np.ndarray, y: np.ndarray, w: np.ndarray, etas: list):
    """(replicate, labels i, labels j, sums) of cells with the design ``m``; its column 0 is overwritten.

    A linear predictor of None stands for the start of the fit.
    """
    iu, ju = np.triu_indices(len(names))
    beside = [_DEVIANCE, _CELLS, _PEARSON]
    i, j = (np.r_[names[at], beside].astype("int32") for at in (iu, ju))
    for r, eta in enumerate(etas):
        if eta is None:
            eta = family.start(y)
        if family.valid(eta):
            var, z, mu = family.working(eta, y)
            m[:, 0] = z
            g = m.T @ (m * (var * w)[:, None])
            dev = float((family.deviance(y, mu) * w).sum())
            pearson = float(((y - mu) ** 2 / family.variance(mu) * w).sum())
        else:      # an infinite deviance tells the solve to step back
            g, dev, pearson = np.zeros((m.shape[1],) * 2), np.inf, np.inf
        yield r, i, j, np.r_[g[iu, ju], dev, w.sum(), pearson]


def _pass(family: Family, reps: int, started: bool):
    """Weighted cross-products of complete cells, batch by batch, per target."""
    def block(target, pdf: pd.DataFrame) -> pd.DataFrame:
        row, cells = pd.factorize(pdf["cell"].to_numpy())
        j, v, n = pdf["j"].to_numpy(), pdf["v"].to_numpy(), len(cells)
        is_y = j == RESPONSE
        y = np.bincount(row[is_y], v[is_y], n)
        w = np.ones(n)
        w[row] = pdf["w"].to_numpy()
        x, labels = row[~is_y], np.unique(j[~is_y])
        m = np.zeros((n, len(labels) + 2))
        m[:, 1] = 1.0
        np.add.at(m, (x, np.searchsorted(labels, j[~is_y]) + 2), v[~is_y])
        names = np.r_[RESPONSE, 0, labels]
        etas = [None] * reps
        if started:
            b = np.stack(pdf["b"].to_numpy())[~is_y]
            b0 = np.asarray(pdf["b0"].iloc[0], float)
            etas = [b0[r] + np.bincount(x, v[~is_y] * b[:, r], n) for r in range(len(b0))]
        return pd.concat([pd.DataFrame({"target": target, "rep": np.int32(r), "i": i, "j": j, "s": s})
                          for r, i, j, s in _weighted(family, names, m, y, w, etas)], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            last = (pdf["target"] == pdf["target"].iloc[-1]) & (pdf["cell"] == pdf["cell"].iloc[-1])
            held, pdf = pdf[last], pdf[~last]
            for target, part in pdf.groupby("target", sort=False):
                for piece in _pieces(part):
                    yield block(target, piece)
        if held is not None and len(held):
            yield block(held["target"].iloc[0], held)
    return run


def _pieces(part: pd.DataFrame):
    """Split a sorted batch between cells so a dense block stays small."""
    cell = part["cell"].to_numpy()
    starts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1]
    step = max(1, _BLOCK_ENTRIES // max(1, part["j"].nunique() + 2))
    cuts = [*starts[::step], len(part)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield part.iloc[a:b]


class _Passes:
    """Design rows spread once and re-used by every iteration."""

    def __init__(self, design: DataFrame, obs: DataFrame, family: Family):
        self.family, self.obs = family, obs
        self.ttype = design.schema["target"].dataType.simpleString()
        bad = self._unfit(design.filter(F.col("j") == RESPONSE).select("target", "v", "w"),
                          design.select("target").distinct())
        self.rows = cut_lineage(spread_design(design.join(bad, "target", "left_anti"), _SALT), keep_layout=True)

    def _unfit(self, y: DataFrame, targets: DataFrame) -> DataFrame:
        """Targets with a response outside the family's range, which have no fit."""
        bad = y.filter(F.coalesce(self.family.outside(F.col("v")) | F.isnan("v"), F.lit(False))).select("target").distinct()
        if self.family.positive:
            held = targets.join(y.groupBy("target").agg(F.sum("w").alias("sw")), "target", "left")
            short = F.coalesce("sw", F.lit(0.0)) < observation_count(self.obs) - 1e-6
            bad = bad.unionByName(held.filter(short).select("target"))
        return bad

    def responses(self) -> DataFrame:
        """``(target, v, w)`` of the stored responses."""
        return self.rows.filter(F.col("j") == RESPONSE).select("target", "v", "w")

    def moments(self) -> DataFrame:
        """``(target, j, s1, s2)``: weighted sums and sums of squares of the terms."""
        return (self.rows.filter("j > 0").groupBy("target", "j")
                .agg(F.sum(F.col("w") * F.col("v")).alias("s1"),
                     F.sum(F.col("w") * F.col("v") * F.col("v")).alias("s2")))

    def sums(self, beta: DataFrame | None, reps: int) -> DataFrame:
        """``(target, rep, i, j, s, n)`` at the given coefficients."""
        cols = ["target", "cell", "j", "v", "w"]
        rows = self.rows
        if beta is not None:
            table = beta.withColumn("salt", all_salts(_SALT))
            rows = rows.join(table, ["target", "salt"])
            at = F.greatest(F.col("j"), F.lit(0)) + 1
            rows = rows.withColumn("b", F.transform("beta", lambda a: F.get(a, at - 1)))
            rows = rows.withColumn("b", F.transform("b", lambda a: F.coalesce(a, F.lit(0.0))))
            rows = rows.withColumn("b0", F.transform("beta", lambda a: F.get(a, F.lit(0))))
            cols += ["b", "b0"]
            rows = rows.sortWithinPartitions("target", "cell")
        part = rows.select(*cols).mapInPandas(
            _pass(self.family, reps, beta is not None),
            f"target {self.ttype}, rep int, i int, j int, s double")
        return (part.groupBy("target", "rep", "i", "j").agg(F.sum("s").alias("s"))
                .withColumn("n", observation_count(self.obs)))

    def null_deviance(self) -> DataFrame:
        """``(target, null_dev)`` of the intercept-only model."""
        summed, dev = self.family.null_deviance()
        d = (self.responses().groupBy("target").agg(F.sum(F.col("w") * F.col("v")).alias("s1"),
                                     F.sum(F.col("w") * summed).alias("sl"))
             .withColumn("n", observation_count(self.obs)))
        return d.filter("s1 > 0").select("target", dev.alias("null_dev"))


class _SlicedPasses(_Passes):
    """Slices of stored values, packed once; the tasks form the design again in every iteration."""

    def __init__(self, design: Design, obs: DataFrame, family: Family):
        self.family, self.obs = family, obs
        self.ttype = design.schema["target"].dataType.simpleString()
        ex = design.expression.select("cell", F.col("feature").alias("target"), F.col("value").cast("double").alias("v"))
        targets = design.terms.select("target").distinct()
        y = salted_join(ex.filter("v <> 0"), targets, ["target"], ["cell"], how="left_semi")
        if "weight" in obs.columns:
            y = y.join(obs.select("cell", F.col("weight").cast("double").alias("w")), "cell")
        else:
            y = y.withColumn("w", F.lit(1.0))
        self.y = y.select("target", "v", "w")
        bad = cut_lineage(self._unfit(self.y, targets))
        terms = design.terms.join(bad, "target", "left_anti")
        self.design = Design(terms, design.expression, design.accessibility, obs)
        self.slices = Slices(self.design)

    def responses(self) -> DataFrame:
        return self.y.join(self.slices.models.select("target"), "target", "left_semi")

    def moments(self) -> DataFrame:
        s1 = F.coalesce(F.sum(F.when(F.col("i") == 0, F.col("s"))), F.lit(0.0))      # sums of 0 have no row
        s2 = F.sum(F.when(F.col("i") == F.col("j"), F.col("s")))
        return (grams(self.design).filter("j > 0").groupBy("target", "j")
                .agg(s1.alias("s1"), s2.alias("s2")).filter("s2 <> 0"))

    def sums(self, beta: DataFrame | None, reps: int) -> DataFrame:
        """``(target, rep, i, j, s, n)`` at the given coefficients."""
        family = self.family

        def products(m: np.ndarray, w: np.ndarray, at: list | None):
            etas = [None] * reps
            if at is not None:      # terms that no cell stores have no coefficients
                etas = [m[:, 1:len(b) + 1] @ np.array(b, float) for b in at]
            return _weighted(family, np.arange(m.shape[1]) + RESPONSE, m, m[:, 0].copy(), w, etas)
        return self.slices.sums(products, beta).withColumn("n", observation_count(self.obs))


def _passes(design: DataFrame | Design, obs: DataFrame, family: Family) -> _Passes:
    return (_SlicedPasses if isinstance(design, Design) else _Passes)(design, obs, family)


def _assemble(pdf: pd.DataFrame, family: Family, b0: float | None):
    """Dense weighted Gram of one target and replicate, zero cells included; deviance and Pearson sum."""
    i, j, s = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["s"].to_numpy()
    dev, pearson = float(s[i == _DEVIANCE].sum()), float(s[i == _PEARSON].sum())
    rest = float(pdf["n"].iloc[0]) - float(s[i == _CELLS].sum())
    ok = i >= RESPONSE
    i, j, s = i[ok] + 1, j[ok] + 1, s[ok]
    size = int(max(j.max(), 1)) + 1
    g = np.zeros((size, size))
    g[i, j] = s
    g[j, i] = s
    if rest > 1e-6:
        zero = np.zeros(1)
        eta = family.start(zero) if b0 is None else np.array([b0])
        if not family.valid(eta):
            return g, np.inf, np.inf
        var, z, mu = family.working(eta, zero)
        g[1, 1] += rest * var[0]
        g[0, 1] += rest * var[0] * z[0]
        g[1, 0] = g[0, 1]
        dev += rest * float(family.deviance(zero, mu)[0])
        pearson += rest * float(mu[0] ** 2 / family.variance(mu)[0])
    return g, dev, pearson


def fit_glm(design: DataFrame | Design, obs: DataFrame, family: str = "poisson", max_iter: int = 25,
            tol: float = 1e-8, link: str | None = None) -> DataFrame:
    """Maximum likelihood fits of all targets.

    Poisson and binomial fits have z statistics and normal p-values; the quasi
    families, ``Gamma`` and ``inverse.gaussian`` estimate their dispersion by
    Pearson's sum and have t statistics. ``link`` (log, logit, identity, inverse
    or 1/mu^2) replaces the usual link. A step to means that the family cannot
    take is halved until it can. A response outside the family, for the positive
    families also one with zeros, has no fit.
    """
    fam = Family(family, link)
    passes = _passes(design, obs, fam)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        beta0, last0 = pdf["beta0"].iloc[0], pdf["last0"].iloc[0]
        here = None if beta0 is None else np.array([float(x) for x in beta0])
        g, dev, pearson = _assemble(pdf, fam, None if here is None else float(here[0]))
        target, n = pdf["target"].iloc[0], float(pdf["n"].iloc[0])
        none = pd.DataFrame({"target": [], "beta": [], "last": [], "se": [], "p": [], "dev": []})
        if here is not None and not np.isfinite(dev):
            if last0 is None:      # no valid coefficients are known
                return none
            back = (here + np.array([float(x) for x in last0])) / 2
            nan = np.full(len(here), np.nan).tolist()
            return pd.DataFrame({"target": [target], "beta": [[back.tolist()]], "last": [list(last0)],
                                 "se": [nan], "p": [nan], "dev": [np.inf]})
        a, c = g[1:, 1:], g[1:, 0]
        try:
            if not np.isfinite(g).all():
                raise np.linalg.LinAlgError
            keep = independent_columns(a, np.diag(a))
            inv = np.linalg.inv(a[np.ix_(keep, keep)])
        except np.linalg.LinAlgError:      # a fit that fails leaves the table
            return none
        free = n - len(keep)
        scale = 1.0 if not fam.dispersed else pearson / free if free > 0 else np.nan
        beta, se = np.zeros(len(c)), np.full(len(c), np.nan)
        beta[keep], se[keep] = inv @ c[keep], np.sqrt(np.maximum(np.diag(inv), 0) * scale)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = beta / se
        p = student_two_sided(z, free) if fam.dispersed else normal_two_sided(z)
        return pd.DataFrame({"target": [target], "beta": [[beta.tolist()]],
                             "last": [None if here is None else here.tolist()],
                             "se": [se.tolist()], "p": [np.asarray(p, float).tolist()], "dev": [dev]})
    schema = (f"target {passes.ttype}, beta array<array<double>>, last array<double>, se array<double>, "
              "p array<double>, dev double")
    state = None
    for it in range(max_iter + 1):
        s = passes.sums(None if state is None else state.select("target", "beta"), 1)
        if state is None:
            nothing = F.lit(None).cast("array<double>")
            s = s.withColumns({"beta0": nothing, "last0": nothing})
        else:
            s = s.join(state.select("target", F.col("beta")[0].alias("beta0"), F.col("last").alias("last0")), "target")
        new = cut_lineage(s.groupBy("target").applyInPandas(step, schema))
        if state is not None and it > 1:
            inf = F.lit(float("inf"))
            gap = F.when((F.col("dev") == inf) | (F.col("old") == inf), inf).otherwise(
                F.abs(F.col("dev") - F.col("old")) / (F.abs("dev") + 0.1))
            moved = new.join(state.select("target", F.col("dev").alias("old")), "target")
            worst = moved.agg(F.max(gap)).first()[0]
            if worst is not None and worst >= tol and it == max_iter:
                state = moved.filter(gap < tol).drop("old")      # fits that still move are no result
                break
            discard(state)
            state = new
            if worst is None or worst < tol:
                break
        else:
            if state is not None:
                discard(state)
            state = new
    return _glm_rows(state.join(passes.null_deviance(), "target", "left"))


def _glm_rows(state: DataFrame) -> DataFrame:
    z = F.col("estimate") / F.col("std_err")
    coefs = (state.select("target", F.posexplode(F.arrays_zip(
        F.col("beta")[0].alias("e"), F.col("se").alias("s"), F.col("p").alias("p"))).alias("j", "t"))
        .select("target", "j", F.col("t.e").alias("estimate"), F.col("t.s").alias("std_err"),
                F.col("t.p").alias("pval"))
        .filter(~F.isnan("std_err"))
        .withColumn("statistic", z))
    gof = state.select("target", F.lit(-1).alias("j"),
                       (1 - F.col("dev") / F.col("null_dev")).alias("rsq"))
    return coefs.unionByName(gof, allowMissingColumns=True)


def fit_penalised(design: DataFrame | Design, obs: DataFrame, family: str, cv: bool = False,
                  alpha: float = 0.5, n_lambda: int = 100, max_iter: int = 100,
                  tol: float = 1e-5) -> DataFrame:
    """Elastic net for counts or classes: every penalty of the path at once.

    One pass computes a weighted Gram for each penalty whose fit still moves; the
    coordinate descent then runs on those small matrices.
    """
    if cv:
        raise ValueError("cross-validation is available for the gaussian family only")
    if family not in ("poisson", "binomial"):
        raise ValueError("penalised fits are available for gaussian, poisson and binomial")
    fam = Family(family)
    passes = _passes(design, obs, fam)
    moments = passes.moments().withColumn("n", observation_count(obs))
    mean = F.col("s1") / F.col("n")
    sds = moments.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct(
        "j", F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean,
                               F.lit(0.0)))))).alias("sd"))      # one entry per term
    ybar = (passes.responses().groupBy("target")
            .agg(F.sum(F.col("w") * F.col("v")).alias("sy"))
            .withColumn("m", F.col("sy") / observation_count(obs)))
    link = F.log("m") if family == "poisson" else F.log(F.col("m") / (1 - F.col("m")))
    p = sds.select("target", F.array_max(F.map_keys("sd")).alias("p"))
    null = (ybar.filter("m > 0").join(p, "target")
            .select("target", F.array_repeat(F.concat(
                F.array(link), F.array_repeat(F.lit(0.0), F.col("p"))), n_lambda).alias("beta"),
                F.lit(None).cast("array<double>").alias("lambdas"),
                F.array_repeat(F.lit(None).cast("double"), n_lambda).alias("dev"),
                F.array_repeat(F.lit(float("inf")), n_lambda).alias("shift")))

    def step(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """One step of the penalties of a target that still move."""
        if not len(own) or not len(pdf):
            return own[["target", "beta", "lambdas", "dev", "shift"]]
        target, n = pdf["target"].iloc[0], float(pdf["n"].iloc[0])
        old = np.array([list(x) for x in own["beta"].iloc[0]])
        entries = dict(own["sd"].iloc[0])
        terms = np.array(sorted(k for k, s in entries.items() if s > 0), dtype=int)
        sd = np.array([entries[k] for k in terms])
        devs, shift = (np.array(own[c].iloc[0], float) for c in ("dev", "shift"))
        lambdas, new, moving = own["lambdas"].iloc[0], old.copy(), np.flatnonzero(shift >= tol)
        for at, part in pdf.groupby("rep"):
            r = int(moving[at])
            b0 = old[r, 0]
            g, devs[r], _ = _assemble(part, fam, b0)
            full = np.zeros((old.shape[1] + 1, old.shape[1] + 1))
            full[:len(g), :len(g)] = g
            a, c = full[1:, 1:], full[1:, 0]
            sw = a[0, 0]
            cx = a[np.ix_(terms, terms)] - np.outer(a[0, terms], a[0, terms]) / sw
            cy = c[terms] - a[0, terms] * c[0] / sw
            cx, cy = cx / np.outer(sd, sd) / n, cy / sd / n
            if lambdas is None:
                lambdas = lambda_path(cy, n, len(terms), alpha, n_lambda)
            b = _weighted_descent(cx, cy, lambdas[r], alpha, old[r, terms] * sd)
            new[r, terms] = b / sd
            new[r, 0] = (c[0] - a[0, terms] @ new[r, terms]) / sw
            shift[r] = np.max(np.abs(new[r] - old[r]))
        return pd.DataFrame({"target": [target], "beta": [new.tolist()], "lambdas": [list(map(float, lambdas))],
                             "dev": [devs.tolist()], "shift": [shift.tolist()]})
    schema = (f"target {passes.ttype}, beta array<array<double>>, lambdas array<double>, "
              "dev array<double>, shift array<double>")
    state = cut_lineage(null)
    still = F.exists("shift", lambda x: x >= tol)
    beta = F.transform(F.filter(F.arrays_zip("beta", "shift"), lambda x: x["shift"] >= tol), lambda x: x["beta"])
    for _ in range(max_iter):
        s = passes.sums(state.filter(still).select("target", beta.alias("beta")), n_lambda)
        old, state = state, cut_lineage(
            s.groupBy("target").cogroup(state.join(sds, "target").groupBy("target")).applyInPandas(step, schema))
        discard(old)
        if state.filter(still).isEmpty():
            break
    # fits that still move are no result
    d = state.filter(F.forall("shift", lambda x: x < tol)).join(passes.null_deviance(), "target")
    ratio = F.transform("dev", lambda x: 1 - x / F.col("null_dev"))
    d = d.withColumn("ratio", ratio)
    k = F.array_position(F.transform(
        "ratio", lambda x: x > F.array_max("ratio") * 0.95), F.lit(True))
    d = d.withColumn("k", k.cast("int")).filter("k > 0")
    coefs = (d.select("target", F.posexplode(F.element_at("beta", F.col("k"))))
             .toDF("target", "j", "estimate"))
    gof = d.select("target", F.lit(-1).alias("j"), F.element_at("ratio", F.col("k")).alias("rsq"),
                   F.element_at("lambdas", F.col("k")).alias("lambda"),
                   F.lit(float(alpha)).alias("alpha"))
    return coefs.unionByName(gof, allowMissingColumns=True)


def _weighted_descent(c, q, lam, alpha, start, tol=1e-8, max_iter=10_000):
    """Coordinate descent for a quadratic with unequal curvatures."""
    beta = start.copy()
    grad = q - c @ beta
    curv = np.diag(c)
    for _ in range(max_iter):
        delta = 0.0
        for k in range(len(q)):
            if curv[k] <= 0:
                continue
            z = grad[k] + curv[k] * beta[k]
            new = np.sign(z) * max(abs(z) - lam * alpha, 0.0) / (curv[k] + lam * (1 - alpha))
            d = new - beta[k]
            if d:
                beta[k] = new
                grad -= c[:, k] * d
                delta = max(delta, curv[k] * d * d)
        if delta < tol:
            break
    return beta
