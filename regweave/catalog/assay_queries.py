"""Registered queries: assay summaries and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from regweave.catalog.views import UPSTREAM, Views, r6, with_views
from regweave.operators import assay as A
from regweave.operators import correlation as C
from regweave.operators.links import link_by_distance

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_GROUPED = """+with g as (select pool grp, count(*) n from cells group by 1),
s as (select pool grp, feature, sum(value) s1, sum(value*value) s2, min(value) lo, max(value) hi,
  count(*) filter (value <> 0) nnz, count(*) stored from expr join cells using (cell) group by 1, 2)
"""
# Every stored value plus the implicit zeros, for order statistics.
_DENSE = """+with seen as (select distinct pool grp, feature from expr join cells using (cell)),
dense as (select s.grp, s.feature, coalesce(e.value, 0) as value from seen s
  join cells c on c.pool=s.grp left join expr e on e.cell=c.cell and e.feature=s.feature)
"""


def _stat(v: Views, fun, groups=("pool",)):
    return A.aggregate_values(v.expr(), v.cells(), list(groups), fun)


def _number(v: Views, fun, groups=("pool",)):
    return _stat(v, fun, groups).select("grp", "feature", r6("value").alias("value"))


@query("agg_mean", with_views("expr cells", _GROUPED + """
select grp, feature, round(s1/n, 6)+0.0 as value from s join g using (grp)"""))
def agg_mean(v):
    return _number(v, "mean")


@query("agg_sum", with_views("expr cells", _GROUPED + """
select grp, feature, round(s1, 6)+0.0 as value from s"""))
def agg_sum(v):
    return _number(v, "sum")


@query("agg_count", with_views("expr cells", _GROUPED + "select grp, feature, nnz as value from s"))
def agg_count(v):
    return _stat(v, "count")


@query("agg_median", with_views("expr cells", _DENSE + """
select grp, feature, round(median(value), 6)+0.0 as value from dense group by 1, 2"""))
def agg_median(v):
    return _number(v, "median")


@query("agg_minmax", with_views("expr cells", _DENSE + """
select grp, feature, round(min(value), 6)+0.0 lo, round(max(value), 6)+0.0 hi from dense group by 1, 2"""))
def agg_minmax(v):
    lo = _number(v, "min").withColumnRenamed("value", "lo")
    return lo.join(_number(v, "max").withColumnRenamed("value", "hi"), ["grp", "feature"])


@query("agg_any_all", with_views("expr cells", _DENSE + """
select grp, feature, bool_or(value <> 0) "any", bool_and(value <> 0) "all" from dense group by 1, 2"""))
def agg_any_all(v):
    some = _stat(v, "any").withColumnRenamed("value", "any")
    return some.join(_stat(v, "all").withColumnRenamed("value", "all"), ["grp", "feature"])


@query("agg_sd", with_views("expr cells", _DENSE + """
select grp, feature, round(stddev_samp(value), 6)+0.0 as value from dense group by 1, 2"""))
def agg_sd(v):
    return _number(v, "sd")


@query("agg_mad", with_views("expr cells", _DENSE + """,
m as (select grp, feature, median(value) med from dense group by 1, 2)
select grp, feature, round(1.4826*median(abs(value-med)), 6)+0.0 as value
from dense join m using (grp, feature) group by 1, 2"""))
def agg_mad(v):
    return _number(v, "mad")


@query("agg_ungrouped", with_views("expr cells", """
select 'all' grp, feature, round(sum(value)/(select count(*) from cells), 6)+0.0 mean,
  count(*) filter (value = 1) ones from expr group by 2"""))
def agg_ungrouped(v):
    mean = A.aggregate_values(v.expr(), v.cells()).select("grp", "feature", r6("value").alias("mean"))
    ones = A.aggregate_values(v.expr(), v.cells(), fun="count").withColumnRenamed("value", "ones")
    return mean.join(ones, ["grp", "feature"])


@query("agg_multikey", with_views("expr cells", """
select concat(pool, '_', cast(batch as varchar)) grp, feature, round(sum(value), 6)+0.0 as value
from expr join cells using (cell) group by 1, 2"""))
def agg_multikey(v):
    return _number(v, "sum", ("pool", "batch"))


@query("agg_custom", with_views("expr cells", _DENSE + """
select grp, feature, round(sum(value*value)/count(*), 6)+0.0 as value from dense group by 1, 2"""))
def agg_custom(v):
    return _number(v, lambda frame: (frame ** 2).mean())


@query("aggregate_assay", with_views("acc cells", """
select 'peaks' assay, pool grp, feature, round(sum(value)/any_value(n), 6)+0.0 as value
from acc join cells using (cell) join (select pool, count(*) n from cells group by 1) using (pool)
group by 2, 3"""))
def aggregate_assay(v):
    d = A.aggregate_values(v.acc(), v.cells(), ["pool"], "mean")
    return d.select(F.lit("peaks").alias("assay"), "grp", "feature", r6("value").alias("value"))


@query("group_broadcast", with_views("expr cells", """
with m as (select pool, feature, sum(value) s, any_value(n) n from expr join cells using (cell)
  join (select pool, count(*) n from cells group by 1) using (pool) group by 1, 2)
select cell, feature, round(s/n, 6)+0.0 as value from cells join m using (pool)""".replace(
    "with m", "+with m")))
def group_broadcast(v):
    s = A.aggregate_values(v.expr(), v.cells(), ["pool"], "mean")
    return A.broadcast_to_cells(s, A.with_group(v.cells(), "pool")).select(
        "cell", "feature", r6("value").alias("value"))


_POOLS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("agg_crosstab", with_views("expr cells", "select feature, " + ", ".join(
    f'round(coalesce(sum(value) filter (pool=\'{p}\'), 0), 6)+0.0 "{p}"' for p in _POOLS)
    + " from expr join cells using (cell) group by 1"))
def agg_crosstab(v):
    d = A.crosstab_values(v.expr(), v.cells(), "pool", _POOLS)
    return d.select("feature", *[r6(p).alias(p) for p in _POOLS])


@query("zscore", with_views("expr emom n", """+with
m as (select feature, s1/n mean, sqrt((s2-n*(s1/n)*(s1/n))/(n-1)) sd from emom cross join n)
select cell, feature, round((value-mean)/sd, 6)+0.0 z from expr join m using (feature)"""))
def zscore(v):
    return A.zscore(v.expr(), v.cells()).select("cell", "feature", r6("z").alias("z"))


@query("covariance", with_views("gcor", "select x, y, round(cov, 6)+0.0 cov from gcor"))
def covariance(v):
    ex = v.expr()
    p = C.all_pairs(ex.select("feature").distinct())
    d = C.covariance_pairs(ex, ex, p, v.cells(), C.cross_products_within(ex))
    return d.select("x", "y", r6("cov").alias("cov"))


@query("sparse_cor_pearson", with_views("gcor", "select x, y, round(cor, 6)+0.0 cor from gcor"))
def sparse_cor_pearson(v):
    return C.correlate(v.expr(), v.cells()).select("x", "y", r6("cor").alias("cor"))


@query("sparse_cor_clamped", with_views("gcor", """
select x, y, greatest(round(cor, 6)+0.0, 0) cor from gcor"""))
def sparse_cor_clamped(v):
    return C.correlate(v.expr(), v.cells(), allow_neg=False).select("x", "y", r6("cor").alias("cor"))


def _link_pairs(v: Views):
    links = link_by_distance(v.regions(), v.genes(), UPSTREAM, 0)
    return links.select(F.col("region_id").alias("x"), F.col("gene").alias("y"))


@query("cross_cor", with_views("lcor", """
select region_id x, target y, round(cor, 6)+0.0 cor from lcor"""))
def cross_cor(v):
    d = C.correlate(v.acc(), v.cells(), v.expr(), _link_pairs(v))
    return d.select("x", "y", r6("cor").alias("cor"))


@query("sparse_cor_spearman", with_views("expr cells", """+with
f as (select distinct feature from expr),
dense as (select c.cell, f.feature, coalesce(e.value, 0) as value from f cross join cells c
  left join expr e on e.cell=c.cell and e.feature=f.feature),
r as (select cell, feature, rank() over (partition by feature order by value)
  + (count(*) over (partition by feature, value) - 1)/2.0 r from dense)
select a.feature x, b.feature y, round(corr(a.r, b.r), 6)+0.0 cor
from r a join r b on a.cell=b.cell and a.feature<=b.feature group by 1, 2"""))
def sparse_cor_spearman(v):
    return C.correlate(v.expr(), v.cells(), method="spearman").select(
        "x", "y", r6("cor").alias("cor"))


@query("sparse_cor_kendall", with_views("links acc expr cells", """+with
dense as (select l.region_id x, l.target y, coalesce(a.value, 0) vx, coalesce(e.value, 0) vy, count(*) c
  from links l cross join cells k left join acc a on a.cell=k.cell and a.feature=l.region_id
  left join expr e on e.cell=k.cell and e.feature=l.target group by 1, 2, 3, 4),
d as (select a.x, a.y, sum(cast(a.c*b.c as double)*sign((a.vx-b.vx)*(a.vy-b.vy)))/2 diff
  from dense a join dense b on a.x=b.x and a.y=b.y group by 1, 2),
n0 as (select x, y, sum(c)*(sum(c)-1)/2.0 n0 from dense group by 1, 2),
n1 as (select x, y, sum(s*(s-1)/2.0) n1 from (select x, y, vx, sum(c) s from dense group by 1, 2, 3) group by 1, 2),
n2 as (select x, y, sum(s*(s-1)/2.0) n2 from (select x, y, vy, sum(c) s from dense group by 1, 2, 3) group by 1, 2)
select x, y, round(diff/(sqrt(n0-n1)*sqrt(n0-n2)), 6)+0.0 cor
from d join n0 using (x, y) join n1 using (x, y) join n2 using (x, y)"""))
def sparse_cor_kendall(v):
    d = C.correlate(v.acc(), v.cells(), v.expr(), _link_pairs(v), method="kendall")
    return d.select("x", "y", r6("cor").alias("cor"))


@query("unpivot_cor", with_views("gcor", """
select source, target, round(cor, 6)+0.0 corr from (
  select x source, y target, cor from gcor union all select y, x, cor from gcor where x <> y)"""))
def unpivot_cor(v):
    full = C.mirror(C.correlate(v.expr(), v.cells()))
    wide = full.groupBy(F.col("x").alias("source")).pivot("y").agg(F.first("cor"))
    from regweave.operators.embedding import to_long
    return to_long(wide, "source").select("source", "target", r6("corr").alias("corr"))
