"""Per-target regressions solved from one distributed Gram table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.functions import solvers
from regweave.functions.columns import safe_divide
from regweave.functions.solvers import System
from regweave.operators import metrics
from regweave.operators.correlation import feature_sums, observation_count
from regweave.operators.gram import (
    INTERCEPT, RESPONSE, bag_totals, gram_by_fold, gram_sums)
from regweave.operators.skew import salted_join

COEF_COLUMNS = {
    "glm": ["estimate", "std_err", "statistic", "pval"],
    "glmnet": ["estimate"],
    "cv.glmnet": ["estimate"],
    "brms": ["estimate", "est_error", "q5", "q95", "pval"],
    "xgb": ["gain", "cover", "frequency"],
    "bagging_ridge": ["estimate", "pval", "neglog10p"],
    "bayesian_ridge": ["estimate", "est_variance", "pval", "neglog10p"],
}
GOF_COLUMNS = {"glmnet": ["rsq", "lambda", "alpha"], "cv.glmnet": ["rsq", "lambda", "alpha"]}
_NUMBERS = ["estimate", "std_err", "statistic", "pval", "est_error", "q5", "q95",
            "est_variance", "neglog10p", "rsq", "lambda", "alpha"]
GOF_ROW = -1


def _schema(df: DataFrame) -> str:
    t = df.schema["target"].dataType.simpleString()
    return f"target {t}, j int, " + ", ".join(f"`{c}` double" for c in _NUMBERS)


def _pack(target, result) -> pd.DataFrame:
    coefs, fit = result
    coefs = pd.concat([coefs, pd.DataFrame([{"j": GOF_ROW, **fit}])], ignore_index=True)
    coefs = coefs.reindex(columns=["j", *_NUMBERS])
    coefs.insert(0, "target", target)
    return coefs


def gram_with_size(design: DataFrame, obs: DataFrame, salt: int = 16) -> DataFrame:
    """Gram rows plus the observation count ``n``, which also is the (0, 0) entry."""
    g = gram_sums(design, salt=salt).withColumn("n", observation_count(obs))
    both = (F.col("i") == INTERCEPT) & (F.col("j") == INTERCEPT)
    return g.withColumn("s", F.when(both, F.col("n")).otherwise(F.col("s")))


def _scaling(base_terms: DataFrame, terms: DataFrame, expression: DataFrame,
             accessibility: DataFrame, obs: DataFrame) -> DataFrame:
    """``(target, j, b, coef)``: z-transformed variables ``j`` as sums of crossed raw ones ``b``.

    ``(t-mt)(a-ma)/(st*sa)`` is linear in 1, t, a and t*a. Constant variables have
    no z-score and their terms disappear.
    """
    n = observation_count(obs)

    def moments(values, name, p):
        s = feature_sums(values, obs).withColumn("n", n)
        mean = F.col("s1") / F.col("n")
        sd = F.sqrt(F.greatest(safe_divide(
            F.col("s2") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))
        return s.select(F.col("feature").alias(name), mean.alias(f"m{p}"),
                        sd.alias(f"s{p}")).filter(F.col(f"s{p}") > 0)
    mt, ma = moments(expression, "tf", "t"), moments(accessibility, "region_id", "a")
    b = base_terms.select("target", F.col("j").alias("b"), F.col("kind").alias("bk"),
                          F.col("tf").alias("btf"), F.col("region_id").alias("brg"))
    t = (terms.join(mt, "tf", "left").join(ma, "region_id", "left")
         .filter("(kind = 'region' or st is not null) and (kind = 'tf' or sa is not null)"))

    def part(kind, base_kind, coef):
        src = t.filter(F.col("kind") == kind)
        if base_kind is None:
            return src.select("target", "j", F.lit(INTERCEPT).alias("b"), coef.alias("coef"))
        cond = [src["target"] == b["target"], b["bk"] == base_kind]
        if "tf" in base_kind:
            cond.append(src["tf"] == b["btf"])
        if "region" in base_kind:
            cond.append(src["region_id"] == b["brg"])
        return src.join(b, cond).select(src["target"], "j", "b", coef.alias("coef"))
    st, sa, m1, m2 = F.col("st"), F.col("sa"), F.col("mt"), F.col("ma")
    maps = [
        part("tf_region", "tf_region", 1 / (st * sa)), part("tf_region", "tf", -m2 / (st * sa)),
        part("tf_region", "region", -m1 / (st * sa)), part("tf_region", None, m1 * m2 / (st * sa)),
        part("tf", "tf", 1 / st), part("tf", None, -m1 / st),
        part("region", "region", 1 / sa), part("region", None, -m2 / sa),
    ]
    y = (terms.select("target").distinct()
         .join(mt.toDF("target", "my", "sy"), "target"))
    maps.append(y.select("target", F.lit(RESPONSE).alias("j"), F.lit(RESPONSE).alias("b"),
                         (1 / F.col("sy")).alias("coef")))
    maps.append(y.select("target", F.lit(RESPONSE).alias("j"), F.lit(INTERCEPT).alias("b"),
                         (-F.col("my") / F.col("sy")).alias("coef")))
    maps.append(y.select("target", F.lit(INTERCEPT).alias("j"), F.lit(INTERCEPT).alias("b"),
                         F.lit(1.0).alias("coef")))
    m = maps[0]
    for extra in maps[1:]:
        m = m.unionByName(extra)
    return m


def scaled_gram(gram: DataFrame, base_terms: DataFrame, terms: DataFrame,
                expression: DataFrame, accessibility: DataFrame, obs: DataFrame,
                by: tuple = ()) -> DataFrame:
    """Gram of z-transformed variables from the Gram of the crossed raw design.

    The scaled Gram is a linear map of the raw one; nothing is densified. ``by``
    names columns beside the target that number several Grams of one target;
    their (0, 0) entries must count all cells.
    """
    m = _scaling(base_terms, terms, expression, accessibility, obs)
    off = gram.filter("i <> j").select("target", *by, F.col("j").alias("i"), F.col("i").alias("j"),
                                       "s", "n")
    full = gram.select("target", *by, "i", "j", "s", "n").unionByName(off)
    left = m.select("target", F.col("b").alias("i"), F.col("j").alias("fi"),
                    F.col("coef").alias("ci"))
    right = m.select("target", F.col("b").alias("j"), F.col("j").alias("fj"),
                     F.col("coef").alias("cj"))
    return (full.join(left, ["target", "i"]).join(right, ["target", "j"])
            .filter("fi <= fj")
            .groupBy("target", *by, F.col("fi").alias("i"), F.col("fj").alias("j"))
            .agg(F.sum(F.col("s") * F.col("ci") * F.col("cj")).alias("s"),
                 F.first("n").alias("n")))


def scaled_rows(design: DataFrame, base_terms: DataFrame, terms: DataFrame, expression: DataFrame,
                accessibility: DataFrame, obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Design rows of z-transformed variables for trees, from the crossed raw rows.

    Terms are shifted so that cells without stored factors keep zero and no row;
    trees do not see shifts. The response is exact; ``zero(target, zero)`` is that
    of cells where it is not stored.
    """
    m = _scaling(base_terms, terms, expression, accessibility, obs)
    zero = m.filter((F.col("j") == RESPONSE) & (F.col("b") == INTERCEPT)).select("target", F.col("coef").alias("zero"))
    unit = m.filter((F.col("j") == RESPONSE) & (F.col("b") == RESPONSE)).select("target", F.col("coef").alias("unit"))
    parts = m.filter("j > 0 and b > 0").join(zero.select("target"), "target", "left_semi")
    raw = design.filter("j > 0").withColumnRenamed("j", "b")
    x = (salted_join(raw, parts, ["target", "b"], ["cell"])
         .groupBy("target", "cell", "j").agg(F.sum(F.col("v") * F.col("coef")).alias("v"), F.first("w").alias("w"))
         .filter("v <> 0").select("target", "cell", "j", "v", "w"))
    y = (design.filter(F.col("j") == RESPONSE).join(zero.join(unit, "target"), "target")
         .select("target", "cell", "j", (F.col("v") * F.col("unit") + F.col("zero")).alias("v"), "w"))
    return x.unionByName(y), zero


def solve_grams(gram: DataFrame, method: str = "glm", **options) -> DataFrame:
    """One small solve per target; a target whose solve fails is left out.

    The result has one row per coefficient (``j = 0`` is the intercept) and one
    goodness-of-fit row with ``j = -1``.
    """
    fns = {"glm": solvers.ols, "glmnet": solvers.elastic_net,
           "bayesian_ridge": solvers.bayesian_ridge, "brms": solvers.bayes_linear}
    solve = fns[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        target = pdf["target"].iloc[0]
        try:
            sys = System.from_rows(pdf["i"], pdf["j"], pdf["s"], float(pdf["n"].iloc[0]))
            return _pack(target, solve(sys, **options))
        except (np.linalg.LinAlgError, ValueError):
            return _pack(target, (pd.DataFrame({"j": []}), {})).iloc[:0]
    return (gram.select("target", "i", "j", "s", "n").groupBy("target")
            .applyInPandas(one, _schema(gram)))


def fit_cv_elastic_net(design: DataFrame, obs: DataFrame, folds: int = 10, seed: int = 1,
                       scaling: Callable | None = None, **options) -> DataFrame:
    """Cross-validated elastic net from one Gram per fold (a single data pass).

    ``scaling(gram, by)`` maps the Gram of a crossed design to that of z-scores.
    """
    w = F.col("weight").cast("double") if "weight" in obs.columns else F.lit(1.0)
    fold = F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(folds)).cast("int")
    sizes = obs.groupBy(fold.alias("fold")).agg(F.sum(w).alias("m"))
    size_map = sizes.agg(F.map_from_entries(
        F.collect_list(F.struct("fold", "m"))).alias("m")).scalar()      # one entry per fold
    rows = gram_by_fold(design, folds, seed)
    if scaling is not None:
        # a fold without stored cells of a target still has its count
        counts = (rows.select("target").distinct().select("target", F.explode(size_map).alias("fold", "s"))
                  .select("target", "fold", F.lit(INTERCEPT).alias("i"), F.lit(INTERCEPT).alias("j"), "s"))
        rows = rows.filter("i <> 0 or j <> 0").unionByName(counts).withColumn("n", F.lit(0.0))
        rows = scaling(rows, ("fold",)).drop("n")
    rows = rows.withColumn("sizes", F.to_json(size_map))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import json
        target = pdf["target"].iloc[0]
        m = {int(k): float(v) for k, v in json.loads(pdf["sizes"].iloc[0]).items()}
        p = int(max(pdf["j"].max(), 0))
        grams = np.zeros((folds, p + 2, p + 2))
        f, i, j = pdf["fold"].to_numpy(), pdf["i"].to_numpy() + 1, pdf["j"].to_numpy() + 1
        grams[f, i, j] = pdf["s"]
        grams[f, j, i] = pdf["s"]
        sizes = [m.get(k, 0.0) for k in range(folds)]
        grams[:, 1, 1] = sizes
        try:
            res = solvers.cv_elastic_net(grams.sum(axis=0), list(grams), sizes, **options)
            return _pack(target, res)
        except (np.linalg.LinAlgError, ValueError):
            return _pack(target, (pd.DataFrame({"j": []}), {})).iloc[:0]
    return rows.groupBy("target").applyInPandas(one, _schema(design))


def fit_bagging_ridge(design: DataFrame, obs: DataFrame, alpha: float = 1.0,
                      bagging_number: int = 200, max_features: float = 0.8, seed: int = 123,
                      p_method: str = "wilcox", scaling: Callable | None = None) -> DataFrame:
    """Ridge on bootstrap replicates and random term subsets, tested over bags.

    ``scaling(gram, by)`` maps the Gram of a crossed design to that of z-scores.
    """
    bags = gram_sums(design, bags=bagging_number, seed=seed)
    bags = bags.join(bag_totals(obs, bagging_number, seed), "rep")
    if scaling is not None:
        both = (F.col("i") == INTERCEPT) & (F.col("j") == INTERCEPT)
        bags = scaling(bags.withColumn("s", F.when(both, F.col("n")).otherwise(F.col("s"))), ("rep",))
    ttype = design.schema["target"].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        target, rep = key
        sys = System.from_rows(pdf["i"], pdf["j"], pdf["s"], float(pdf["n"].iloc[0]))
        p = len(sys.xy)
        if p < 2:
            return pd.DataFrame({"target": [], "j": [], "b": []})
        rng = np.random.default_rng([seed, int(rep)])
        cols = np.sort(rng.choice(p, max(1, int(max_features * p)), replace=False))
        return pd.DataFrame({"target": target, "j": sys.labels[cols].astype("int32"),
                             "b": solvers.ridge(sys, alpha, cols)})
    draws = bags.groupBy("target", "rep").applyInPandas(one, f"target {ttype}, j int, b double")
    mean = draws.groupBy("target", "j").agg(F.avg("b").alias("estimate"))
    test = metrics.wilcoxon_test if p_method == "wilcox" else metrics.t_test
    coefs = (mean.join(test(draws, ["target", "j"], "b").select("target", "j", "pval"),
                       ["target", "j"], "left")
             .withColumn("neglog10p", F.when(F.col("pval") == 0, F.lit(float("inf")))
                         .otherwise(-F.log10(F.coalesce("pval", F.lit(1.0))))))
    gram = gram_with_size(design, obs)
    if scaling is not None:
        gram = scaling(gram, ())
    est = coefs.select("target", F.col("j").alias("i"), F.col("estimate").alias("s"),
                       F.lit(-2).alias("j"), F.lit(0.0).alias("n"))
    both = gram.select("target", "i", "s", "j", "n").unionByName(est)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf["j"] == -2]
        g = pdf[pdf["j"] != -2]
        if e.empty or g.empty:
            return pd.DataFrame({"target": [], "rsq": []})
        sys = System.from_rows(g["i"], g["j"], g["s"], float(g["n"].iloc[0]))
        beta = np.zeros(len(sys.xy))
        beta[e["i"].to_numpy() - 1] = e["s"]
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "rsq": [sys.rsq(beta)]})
    gof = both.groupBy("target").applyInPandas(fit, f"target {ttype}, rsq double")
    return _superset(coefs).unionByName(_superset(gof.withColumn("j", F.lit(GOF_ROW))))


def _superset(df: DataFrame, extra: tuple = ()) -> DataFrame:
    have = set(df.columns)
    return df.select("target", F.col("j").cast("int").alias("j"), *[
        F.col(f"`{c}`") if c in have else F.lit(None).cast("double").alias(c)
        for c in (*_NUMBERS, *extra)])


def univariate_fits(pairs: DataFrame, x: DataFrame, y: DataFrame, obs: DataFrame) -> DataFrame:
    """Single-regressor least squares per (x, y) pair as plain column arithmetic."""
    from regweave.operators.correlation import cross_products
    n = observation_count(obs)
    d = (pairs.select("x", "y").distinct()
         .join(feature_sums(x, obs).toDF("x", "sx", "sxx"), "x")
         .join(feature_sums(y, obs).toDF("y", "sy", "syy"), "y")
         .join(cross_products(x, y, pairs, obs), ["x", "y"], "left")
         .fillna(0.0, ["sxy"]).withColumn("n", n))
    nn = F.col("n")
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / nn
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / nn
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / nn
    d = d.withColumns({"slope": safe_divide(cxy, cxx)})
    d = d.withColumn("rss", F.greatest(cyy - F.col("slope") * cxy, F.lit(0.0)))
    d = d.withColumn("std_err", F.sqrt(safe_divide(F.col("rss"), (nn - 2) * cxx)))
    return d.select(
        "x", "y", F.col("slope").alias("estimate"),
        ((F.col("sy") - F.col("slope") * F.col("sx")) / nn).alias("intercept"), "std_err",
        safe_divide(F.col("slope"), F.col("std_err")).alias("statistic"),
        (1 - safe_divide(F.col("rss"), cyy)).alias("rsq"))


def fit_models(design: DataFrame, obs: DataFrame, method: str = "glm",
               family: str = "gaussian", **options) -> DataFrame:
    """Dispatch over the supported methods on one design."""
    from regweave.operators import boosting, irls
    if method not in COEF_COLUMNS:
        raise ValueError(f"method must be one of {sorted(COEF_COLUMNS)}")
    if family != "gaussian":
        if method == "glm":
            return _superset(irls.fit_glm(design, obs, family, **options))
        if method in ("glmnet", "cv.glmnet"):
            return _superset(irls.fit_penalised(design, obs, family,
                                                cv=method == "cv.glmnet", **options))
        if method == "xgb":
            return boosting.fit_boosting(design, obs, objective=family, **options)
        raise ValueError(f"family {family!r} is not available for {method!r}")
    if method == "cv.glmnet":
        return fit_cv_elastic_net(design, obs, **options)
    if method == "bagging_ridge":
        return fit_bagging_ridge(design, obs, **options)
    if method == "xgb":
        return boosting.fit_boosting(design, obs, **options)
    return solve_grams(gram_with_size(design, obs), method, **options)


def observed_response(values: DataFrame, targets: DataFrame) -> DataFrame:
    return salted_join(values, targets.select(F.col("target").alias("feature")),
                       ["feature"], ["cell"], how="left_semi")
