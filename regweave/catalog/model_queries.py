"""Registered queries: candidate pairs, designs, regressions and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from regweave.catalog import regression_sql as S
from regweave.catalog.region_queries import WITHOUT_EXONS
from regweave.catalog.views import PEAK_COR, SQL_VIEWS, TF_COR, UPSTREAM, Views, r6, with_views
from regweave.operators import adjust, coefficients
from regweave.operators import design as D
from regweave.operators import metrics as X
from regweave.operators import models as M
from regweave.operators.design import target_features
from regweave.operators.packed import Design
from regweave.plans import inference as P

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


OPTIONS = {"upstream": UPSTREAM, "peak_cor": PEAK_COR, "tf_cor": TF_COR}


def inputs(v: Views, annotation) -> P.Study:
    """A study on stored assays, made from the sales in one pass."""
    return P.Study(*v.assays(), v.cells(), v.features(), annotation)


def study(v: Views) -> P.Study:
    s = inputs(v, v.genes())
    s.regions = v.regions()
    return s.set_motifs(v.motif_hits(), v.motif_tf())


def candidates(v: Views, **options) -> P.Candidates:
    return P.find_candidates(study(v), **{**OPTIONS, **options})


def _design(v: Views, interaction: str = ":"):
    c = candidates(v)
    terms = D.model_terms(c.pairs, interaction)
    return c, terms, Design(terms, c.expression, c.accessibility, c.obs)


@query("target_features", with_views("annotation features", """
select distinct gene from annotation where gene in (select feature from features)"""))
def target_features_(v):
    return target_features(v.annotation(), v.features())


@query("peak_gene_links", with_views("lcor motif_hits", f"""
select target, region_id, round(cor, 6)+0.0 cor from lcor where abs(cor) > {PEAK_COR}
and region_id in (select region_id from motif_hits)"""))
def peak_gene_links(v):
    return candidates(v).kept_links.select("target", "region_id", r6("cor").alias("cor"))


@query("tf_gene_links", with_views("tcor", f"""
select target, tf, round(cor, 6)+0.0 cor from tcor where abs(cor) > {TF_COR}"""))
def tf_gene_links(v):
    return candidates(v).kept_tfs.select("target", "tf", r6("cor").alias("cor"))


_STRICT = {"upstream": 1500, "peak_cor": 0.05, "tf_cor": 0.145}


@query("skip_reasons", with_views("features links lcor cand pairs motif_hits", """
select feature target, case
  when feature not in (select target from links where region_id in (select region_id from motif_hits))
    then 'no nearby region'
  when feature not in (select target from lcor where abs(cor) > 0.02
    and region_id in (select region_id from motif_hits)) then 'no correlated region'
  when feature not in (select target from cand) then 'no motif in region'
  when feature not in (select target from pairs) then 'no correlated TF' end reason
from features where feature not in (select target from pairs)""")
    .replace("10000", "1500").replace("> 0.02", "> 0.05").replace("> 0.1\n", "> 0.145\n")
    .replace("> 0.1)", "> 0.145)"))
def skip_reasons(v):
    s = study(v)
    c = P.find_candidates(s, **_STRICT)
    return P.skipped_targets(s, c, v.features().select(F.col("feature").alias("gene")))


@query("model_pairs", with_views("pairs", "select target, region_id, tf from pairs"))
def model_pairs(v):
    return candidates(v).pairs


_TERMS = """+with raw as (
  select distinct target, 0 k, cast(null as varchar) tf, region_id from pairs
  union select distinct target, 1, tf, null from pairs
  union select distinct target, 2, tf, region_id from pairs),
terms as (select target, row_number() over (partition by target
  order by k, region_id nulls first, tf nulls first) j,
  case k when 0 then 'region' when 1 then 'tf' else 'tf_region' end kind, tf, region_id from raw)
"""


@query("model_terms", with_views("pairs", _TERMS + """
select target, cast(j as int) j, kind, tf, region_id,
  concat_ws(':', translate(region_id, '-', '_'), translate(tf, '-', '_')) term from terms"""))
def model_terms(v):
    return D.model_terms(candidates(v).pairs, "*")


@query("nvariables", with_views("pairs", "select target, count(*) nvariables from pairs group by 1"))
def nvariables(v):
    return D.pair_counts(candidates(v).pairs)


@query("gram", with_views("pairs expr acc n", """+with
t as (select target, row_number() over (partition by target order by region_id, tf) j, tf, region_id
  from pairs),
d as (select target, cell, j, e.value*a.value as v from t join acc a on a.feature=region_id
  join expr e using (cell) where e.feature=tf
  union all select target, cell, -1, value from (select distinct target from t) join expr
    on feature=target),
full_d as (select * from d union all select distinct target, cell, 0, 1 from d),
s as (select a.target, a.j i, b.j j, sum(a.v*b.v) s from full_d a join full_d b
  on a.target=b.target and a.cell=b.cell and a.j<=b.j group by 1, 2, 3)
select target, cast(i as int) i, cast(j as int) j,
  round(case when i=0 and j=0 then n else s end, 6)+0.0 s from s cross join n"""))
def gram(v):
    c, terms, rows = _design(v)
    return M.gram_with_size(rows, c.obs).select("target", "i", "j", r6("s").alias("s"))


@query("glm_univariate", with_views("links acc expr amom emom n", """+with
d as (select l.region_id x, l.target y, a.s1 sx, a.s2 sxx, e.s1 sy, e.s2 syy, n, coalesce((
    select sum(p.value*q.value) from acc p join expr q using (cell)
    where p.feature=l.region_id and q.feature=l.target), 0) sxy
  from links l join amom a on a.feature=l.region_id join emom e on e.feature=l.target cross join n),
c as (select *, sxx-sx*sx/n cxx, sxy-sx*sy/n cxy, syy-sy*sy/n cyy from d),
f as (select *, cxy/cxx slope, greatest(cyy-cxy/cxx*cxy, 0) rss from c)
select x, y, round(slope, 6)+0.0 estimate, round((sy-slope*sx)/n, 6)+0.0 intercept,
  round(sqrt(rss/((n-2)*cxx)), 6)+0.0 std_err, round(slope/sqrt(rss/((n-2)*cxx)), 6)+0.0 statistic,
  round(1-rss/cyy, 6)+0.0 rsq from f"""))
def glm_univariate(v):
    from regweave.operators.links import link_by_distance
    links = link_by_distance(v.regions(), v.genes(), UPSTREAM, 0)
    pairs = links.select(F.col("region_id").alias("x"), F.col("gene").alias("y"))
    d = M.univariate_fits(pairs, v.acc(), v.expr(), v.cells())
    return d.select("x", "y", *[r6(c).alias(c) for c in (
        "estimate", "intercept", "std_err", "statistic", "rsq")])


def _network(v: Views, method: str, fit_options=None, **options) -> P.Network:
    return P.infer_network(study(v), method=method, fit_options=fit_options,
                           **{**OPTIONS, **options})


@query("infer_grn", with_views("pairs expr acc n tcor", S.least_squares(S.PAIR_TERMS, """
select tf, target, region_id region, concat_ws(':', translate(region_id, '-', '_'), translate(tf, '-', '_')) term,
  round(est, 6)+0.0 estimate, round(se, 6)+0.0 std_err, round(est/se, 5)+0.0 statistic, round(cor, 6)+0.0 corr
from coef join t using (target, j) left join tcor using (target, tf)"""), WITHOUT_EXONS))
def infer_grn(v):
    """The whole way: candidate regions without exons, links, screens, models."""
    s = inputs(v, v.annotation())
    s.initiate(v.peaks())
    hits = v.motif_hits().withColumnRenamed("region_id", "peak_id")
    s.set_motifs(s.regions.join(hits, "peak_id").select("region_id", "motif"), v.motif_tf())
    genes = s.annotation
    s.annotation = genes.filter("type = 'gene'")
    d = P.infer_network(s, **OPTIONS).coefs
    return d.select("tf", "target", "region", "term", r6("estimate").alias("estimate"), r6("std_err").alias("std_err"),
                    (F.round("statistic", 5) + 0.0).alias("statistic"), r6("corr").alias("corr"))


def _estimates(coefs):
    return coefs.select("target", "tf", "region", r6("estimate").alias("estimate"), r6("std_err").alias("std_err"),
                        (F.round("statistic", 5) + 0.0).alias("statistic"))


@query("glm_gaussian", with_views("pairs expr acc n", S.least_squares(S.PAIR_TERMS, S.COEFFICIENTS)))
def glm_gaussian(v):
    return _estimates(_network(v, "glm").coefs)


@query("glm_scaled", with_views("pairs expr acc n emom amom cells",
                                S.least_squares(S.SCALED_TERMS, S.COEFFICIENTS)))
def glm_scaled(v):
    return _estimates(_network(v, "glm", scale=True).coefs)


def _group_means(view: str) -> str:
    """Each cell gets the mean of its pool and batch."""
    return f"""select c.cell, feature, s/k as value from (
  select concat_ws('_', pool, batch) g, feature, sum(value) s from {view} join cells using (cell) group by 1, 2) q
  join sizes on sizes.g=q.g join cells c on concat_ws('_', c.pool, c.batch)=q.g"""


_METACELLS = {
    "expr_": (SQL_VIEWS["expr"], []), "acc_": (SQL_VIEWS["acc"], []),
    "sizes": ("select concat_ws('_', pool, batch) g, count(*) k from cells group by 1", ["cells"]),
    "expr": (_group_means("expr_"), ["expr_", "cells", "sizes"]),
    "acc": (_group_means("acc_"), ["acc_", "cells", "sizes"]),
}


def _metacell_network(v: Views, **options) -> P.Network:
    s = study(v)
    s.cells = v.cells().withColumn("meta", F.concat_ws("_", "pool", "batch"))
    return P.infer_network(s, aggregate_rna_col="meta", aggregate_peaks_col="meta", **OPTIONS, **options)


@query("glm_metacells", with_views("pairs expr acc n", S.least_squares(S.PAIR_TERMS, S.COEFFICIENTS), _METACELLS))
def glm_metacells(v):
    return _estimates(_metacell_network(v).coefs)


@query("glm_gof", with_views("pairs expr acc n", S.least_squares(S.MAIN_TERMS, S.FITS)))
def glm_gof(v):
    return _network(v, "glm", interaction="+").gof.select("target", r6("rsq").alias("rsq"), "nvariables")


@query("glm_poisson")
def glm_poisson(v):
    return _network(v, "glm", family="poisson").coefs


@query("glm_quasipoisson", with_views("pairs expr acc n cells", S.reweighted(S.PAIR_TERMS, "poisson", True), _METACELLS))
def glm_quasipoisson(v):
    return _estimates(_metacell_network(v, family="quasipoisson").coefs)


@query("glm_gamma", with_views("pairs expr acc n cells", S.reweighted(S.PAIR_TERMS, "Gamma", True), _METACELLS))
def glm_gamma(v):
    return _estimates(_metacell_network(v, family="Gamma").coefs)


@query("glmnet")
def glmnet(v):
    return _network(v, "glmnet", {"alpha": 0.5}).coefs


@query("glmnet_poisson")
def glmnet_poisson(v):
    return _network(v, "glmnet", family="poisson").coefs


@query("cv_glmnet")
def cv_glmnet(v):
    return _network(v, "cv.glmnet").coefs


@query("bagging_ridge")
def bagging_ridge(v):
    return _network(v, "bagging_ridge").coefs


@query("bayesian_ridge")
def bayesian_ridge(v):
    return _network(v, "bayesian_ridge").coefs


@query("bayes_linear")
def bayes_linear(v):
    return _network(v, "brms").coefs


@query("gbt_importance")
def gbt_importance(v):
    return _network(v, "xgb").coefs


@query("coef_with_corr", with_views("coefs expr cells", """+with c as (
  select target, tf, round(sum(estimate), 6)+0.0 corr from coefs group by 1, 2 having count(*) > 1)
select tf, target, region, estimate, corr from coefs left join c using (target, tf)"""))
def coef_with_corr(v):
    c = v.coefs()
    corr = c.groupBy("target", "tf").agg(
        F.sum("estimate").alias("e"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    corr = corr.select("target", "tf", r6("e").alias("cor"))
    return coefficients.attach_correlation(c.select("tf", "target", "region", "estimate"), corr)


@query("format_coefs", with_views("coefs", """+with
t as (select target, tf, translate(region, '-', '_') rg, estimate, pval from coefs),
r as (select *, count(*) over () n, rank() over (order by pval) + count(*) over (partition by pval) - 1 hi
  from t),
u as (select distinct pval, least(1, min(pval*n/hi) over (order by pval desc
  rows unbounded preceding)) padj from (select distinct pval, n, hi from r))
select tf, target, translate(rg, '_', '-') region,
  case when estimate > 0 then concat(tf, ':', rg) else concat(rg, ':', tf) end term,
  estimate, r.pval, round(padj, 6)+0.0 padj from r join u on r.pval=u.pval"""))
def format_coefs(v):
    rg = F.translate("region", "-", "_")
    d = v.coefs().select("target", F.when(
        F.col("estimate") > 0, F.concat("tf", F.lit(":"), rg)).otherwise(
        F.concat(rg, F.lit(":"), "tf")).alias("term"), "estimate", "pval")
    return coefficients.format_coefs(d).withColumn("padj", r6("padj"))


_RANKED = """+with
k as (select pval, count(*) c from pvals where pval is not null group by 1),
r as (select pval, c, sum(c) over () n, sum(c) over (order by pval) hi from k)
"""


@query("padj_bh", with_views("pvals", _RANKED + """,
a as (select pval, least(1, min(pval*n/hi) over (order by pval desc rows unbounded preceding)) padj from r)
select event_id, p.pval, round(padj, 6)+0.0 padj from pvals p left join a on a.pval=p.pval"""))
def padj_bh(v):
    d = adjust.adjust_pvalues(v.pvals(), method="fdr")
    return d.select("event_id", "pval", r6("padj").alias("padj"))


@query("padj_methods", with_views("pvals", _RANKED + """,
h as (select sum(1.0/i) q from (select unnest(range(1, (select max(n) from r)::bigint + 1)) i)),
a as (select pval, least(1, pval*n) bonferroni,
  least(1, max((n-hi+c)*pval) over (order by pval rows unbounded preceding)) holm,
  least(1, min((n-hi+1)*pval) over (order by pval desc rows unbounded preceding)) hochberg,
  least(1, min(q*pval*n/hi) over (order by pval desc rows unbounded preceding)) "BY"
  from r cross join h)
select event_id, round(bonferroni, 6)+0.0 bonferroni, round(holm, 6)+0.0 holm,
  round(hochberg, 6)+0.0 hochberg, round("BY", 6)+0.0 "BY", round(pval, 6)+0.0 "none"
from pvals left join a using (pval)"""))
def padj_methods(v):
    d = v.pvals()
    names = ("bonferroni", "holm", "hochberg", "BY", "none")
    vals = None
    for m in names:
        a = adjust.adjusted_values(d, method=m).select("value", F.col("adj").alias(m))
        vals = a if vals is None else vals.join(a, "value")
    return (d.join(vals, d["pval"] == vals["value"], "left")
            .select("event_id", *[r6(m).alias(m) for m in names]))


def _predictions(v: Views):
    return v.table("lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("y_true"),
        (F.col("l_quantity") * (1 - F.col("l_discount")) + 1).alias("y_pred"))


@query("r2_metrics", """
select grp, round(sse, 4)+0.0 sse, round(sse/sst, 6)+0.0 rse, round(1-sse/sst, 6)+0.0 r2 from (
  select l_returnflag grp, sum((l_quantity-p)*(l_quantity-p)) sse,
    sum(l_quantity*l_quantity)-sum(l_quantity)*sum(l_quantity)/count(*) sst
  from (select *, l_quantity*(1-l_discount)+1 p from lineitem) group by 1)""")
def r2_metrics(v):
    d = X.error_metrics(_predictions(v), keys=["grp"])
    return d.select("grp", (F.round("sse", 4) + 0.0).alias("sse"), r6("rse").alias("rse"),
                    r6("r2").alias("r2"))


@query("error_metrics", """
select l_returnflag grp, round(avg(abs(e)), 6)+0.0 mae, round(avg(abs(e/l_quantity)), 6)+0.0 mape,
  round(avg(e*e), 6)+0.0 mse, round(sqrt(avg(e*e)), 6)+0.0 rmse
from (select *, l_quantity*(1-l_discount)+1-l_quantity e from lineitem) group by 1""")
def error_metrics(v):
    d = X.error_metrics(_predictions(v), keys=["grp"])
    return d.select("grp", *[r6(c).alias(c) for c in ("mae", "mape", "mse", "rmse")])


@query("cv_folds", """
select event_type, fold, n, n - min(n) over (partition by event_type) <= 1 balanced from (
  select event_type, cast(f as int) fold, c//5 + case when f <= c%5 then 1 else 0 end n
  from (select event_type, count(*) c from events group by 1), range(1, 6) t(f))""")
def cv_folds(v):
    d = X.cv_folds(v.table("events").select("event_id", "event_type"), "event_id", 5, "event_type")
    sizes = d.groupBy("event_type", "fold").agg(F.count(F.lit(1)).alias("n"))
    low = sizes.groupBy("event_type").agg(F.min("n").alias("lo"))
    return sizes.join(low, "event_type").select(
        "event_type", "fold", "n", (F.col("n") - F.col("lo") <= 1).alias("balanced"))


@query("wilcoxon", with_views("coefs", """+with
a as (select target, estimate x, rank() over (partition by target order by abs(estimate))
  + (count(*) over (partition by target, abs(estimate))-1)/2.0 r,
  count(*) over (partition by target, abs(estimate)) c from coefs where estimate <> 0),
s as (select target, sum(case when x > 0 then r else 0 end) v, cast(count(*) as double) n,
  sum(c*c-1) ties from a group by 1),
d as (select *, v-n*(n+1)/4 diff from s)
select target, round(v, 6)+0.0 v, n, round((diff-sign(diff)*0.5) /
  nullif(sqrt(n*(n+1)*(2*n+1)/24-ties/48.0), 0), 6)+0.0 z from d"""))
def wilcoxon(v):
    d = X.wilcoxon_test(v.coefs(), ["target"], "estimate")
    return d.select("target", r6("v").alias("v"), "n", r6("z").alias("z"))


@query("wilcoxon_exact", with_views("coefs", """+with
d as (select 0 n, 0 s, 1::hugeint c union all
  select n+1 n, s, sum(c)::hugeint c from (select n, unnest([s, s+n+1]) s, c from d where n < 49) group by 1, 2),
t as (select n, s, sum(c) over (partition by n order by s)/(2.0::double^n) p from d),
m as (select target, max(estimate) x from coefs where estimate <> 0 group by target, abs(estimate)),
a as (select target, x, rank() over (partition by target order by abs(x)) r from m),
s as (select target, cast(sum(case when x > 0 then r else 0 end) as int) v, cast(count(*) as int) n from a
  group by 1 having count(*) < 50)
select target, cast(v as double) v, cast(s.n as double) n, round(least(1, 2*case when 4*v > s.n*(s.n+1)
  then 1-coalesce(lo.p, 0) else hi.p end), 6)+0.0 pval
from s join t hi on hi.n=s.n and hi.s=v left join t lo on lo.n=s.n and lo.s=v-1"""))
def wilcoxon_exact(v):
    coefs = v.coefs()
    m = coefs.filter("estimate <> 0").groupBy("target", F.abs("estimate")).agg(F.max("estimate").alias("estimate"))
    few = m.groupBy("target").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") < X.EXACT_BELOW)
    plain = m.join(few, "target", "left_semi")
    d = X.wilcoxon_test(plain, ["target"], "estimate")
    return d.select("target", r6("v").alias("v"), "n", r6("pval").alias("pval"))


@query("bag_t_test", with_views("coefs", """
select target, count(*) n, round(sum(estimate), 6)+0.0 total,
  round(avg(estimate)*sqrt(count(*))/nullif(stddev_samp(estimate), 0), 4)+0.0 statistic
from coefs group by 1"""))
def bag_t_test(v):
    d = X.t_test(v.coefs(), ["target"], "estimate")
    return d.select("target", "n", r6(F.col("mean") * F.col("n")).alias("total"),
                    (F.round("statistic", 4) + 0.0).alias("statistic"))
