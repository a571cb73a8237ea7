"""Registered queries: intervals, candidate regions, links and motif evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from regweave.catalog.views import SQL_VIEWS, MIN_GENES, Views, r6, with_views  # noqa: F401
from regweave.functions.columns import region_name, split_region
from regweave.operators import intervals as I
from regweave.operators import links as L
from regweave.operators import motifs as M
from regweave.plans import regions as R

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _side(v: Views, kind: str, tag: str):
    """The clicks, or all other events: together the whole table."""
    is_click = F.col("event_type") == "click"
    return v.intervals().filter(is_click if kind == "click" else ~is_click).select(
        "chrom", "start", "end", F.col("event_id").alias(f"{tag}_id"))


@query("parse_regions", with_views("acc", """
select distinct feature, regexp_extract(feature, '^(.+)-(\\d+)-(\\d+)$', 1) chrom,
  cast(regexp_extract(feature, '^(.+)-(\\d+)-(\\d+)$', 2) as bigint) as "start",
  cast(regexp_extract(feature, '^(.+)-(\\d+)-(\\d+)$', 3) as bigint) as "end",
  regexp_replace(feature, '^(.+)-(\\d+)-(\\d+)$', '\\1:\\2_\\3') as label from acc"""))
def parse_regions(v):
    d = split_region(v.acc().select("feature").distinct(), "feature")
    return d.withColumn("label", region_name(sep=(":", "_")))


def _overlap_sql(width: int) -> str:
    return with_views("intervals", f"""
select a.event_id click_id, b.event_id other_id, a.chrom,
  least(a."end", b."end") - greatest(a."start", b."start") + 1 width
from intervals a join intervals b on a.chrom=b.chrom and a."start"<=b."end" and b."start"<=a."end"
where a.event_type='click' and b.event_type<>'click'
  and least(a."end", b."end") - greatest(a."start", b."start") + 1 >= {width}""")


@query("interval_overlap", _overlap_sql(1))
def interval_overlap(v):
    return I.overlap_join(_side(v, "click", "click"), _side(v, "other", "other")).select(
        "click_id", "other_id", "chrom", "width")


@query("interval_overlap_min2", _overlap_sql(2))
def interval_overlap_min2(v):
    return I.overlap_join(_side(v, "click", "click"), _side(v, "other", "other"),
                          min_overlap=2).select("click_id", "other_id", "chrom", "width")


@query("candidate_regions", with_views("intervals", """
select a.event_id peak_id, a.chrom, greatest(a."start", b."start") as "start",
  least(a."end", b."end") as "end"
from intervals a join intervals b on a.chrom=b.chrom and a."start"<=b."end" and b."start"<=a."end"
where a.event_type='click' and b.event_type<>'click' group by all"""))
def candidate_regions(v):
    peaks = _side(v, "click", "peak")
    return R.candidate_regions(peaks, _side(v, "other", "other")).select(
        "peak_id", "chrom", "start", "end")


_MERGE = """{src}_m as (select chrom, s0 as "start", max(e0) as "end" from (
  select chrom, s, e0, max(case when brk then s end) over (partition by chrom order by s
      rows unbounded preceding) s0 from (
    select chrom, s, e0, coalesce(s > max(e0) over (partition by chrom order by s
      rows between unbounded preceding and 1 preceding) + 1, true) brk
    from (select chrom, "start" s, max("end") e0 from {src} group by 1, 2))) group by 1, 2)"""


def _merged(src: str) -> str:
    return _MERGE.format(src=src)


@query("interval_merge", with_views("intervals", "+with " + _merged("intervals") + """
select * from intervals_m"""))
def interval_merge(v):
    return I.merge_intervals(v.intervals().select("chrom", "start", "end"))


@query("interval_subtract", with_views("intervals", "+with holes as (select * from intervals "
       "where event_type<>'click'), " + _merged("holes") + """,
h as (select a.event_id, a."start" s, a."end" e, m."start" cs, m."end" ce from intervals a
  join holes_m m on a.chrom=m.chrom and a."start"<=m."end" and m."start"<=a."end"
  where a.event_type='click'
  union all select event_id, "start", "end", "end"+1, null from intervals where event_type='click'),
g as (select event_id, e, greatest(coalesce(lag(ce) over (partition by event_id order by cs)+1, s), s) lo,
  least(cs-1, e) hi from h)
select event_id click_id, lo as "start", hi as "end" from g where lo <= hi"""))
def interval_subtract(v):
    holes = I.merge_intervals(_side(v, "other", "other").select("chrom", "start", "end"))
    return I.subtract_intervals(_side(v, "click", "click"), holes, "click_id").select(
        "click_id", "start", "end")


@query("interval_union", with_views("intervals", "+with both_sets as (select * from intervals), "
       + _merged("both_sets") + """
select * from both_sets_m"""))
def interval_union(v):
    return I.union_intervals(_side(v, "click", "c"), _side(v, "other", "o"))


@query("interval_intersect", with_views("intervals", "+with ca as (select * from intervals "
       "where event_type='click'), vb as (select * from intervals where event_type<>'click'), "
       + _merged("ca") + ", " + _merged("vb") + """,
x as (select a.chrom, greatest(a."start", b."start") as "start", least(a."end", b."end") as "end"
  from ca_m a join vb_m b on a.chrom=b.chrom and a."start"<=b."end" and b."start"<=a."end"), """
       + _merged("x") + " select * from x_m"))
def interval_intersect(v):
    return I.intersect_intervals(_side(v, "click", "c"), _side(v, "other", "o"))


@query("interval_extend", with_views("intervals", """
select event_id, case when strand='-' then "start"-200 else "start"-500 end as "start",
  case when strand='-' then "end"+500 else "end"+200 end as "end" from intervals"""))
def interval_extend(v):
    return I.extend_intervals(v.intervals(), 500, 200).select("event_id", "start", "end")


@query("tss", with_views("intervals", """
select event_id, case when strand='-' then "end" else "start" end as "start",
  case when strand='-' then "end" else "start" end as "end" from intervals"""))
def tss(v):
    return I.to_tss(v.intervals()).select("event_id", "start", "end")


def _near_sql(lo: str, hi: str, up: int, down: int) -> str:
    return with_views("peaks genes", f"""
select distinct gene, peak_id region_id from peaks p join genes g on p.chrom=g.chrom
  and p."start" <= {hi} + case when strand='-' then {up} else {down} end
  and p."end" >= {lo} - case when strand='-' then {down} else {up} end""")


@query("peaks_near_genes", _near_sql('g."start"', 'g."end"', 10000, 1000))
def peaks_near_genes(v):
    return L.link_by_distance(v.regions(), v.genes(), 10000, 1000)


_TSS = "case when strand='-' then g.\"end\" else g.\"start\" end"


@query("peaks_near_tss", _near_sql(_TSS, _TSS, 10000, 1000))
def peaks_near_tss(v):
    return L.link_by_distance(v.regions(), v.genes(), 10000, 1000, only_tss=True)


@query("great_links", with_views("peaks genes", """+with
d as (select gene, chrom, "start" gs, "end" ge,
  "start" - case when strand='-' then 500 else 3000 end bs,
  "end" + case when strand='-' then 3000 else 500 end be from genes),
t1 as (select distinct gene, peak_id region_id from peaks p join d on p.chrom=d.chrom
  and least(p."end", be) - greatest(p."start", bs) + 1 >= 2),
t2 as (select distinct gene, peak_id region_id from peaks p join d on p.chrom=d.chrom
  and least(p."end", ge) - greatest(p."start", gs) + 1 >= 2
  where peak_id not in (select region_id from t1)),
t3 as (select distinct gene, peak_id region_id from peaks p join d on p.chrom=d.chrom
  and least(p."end", be+9000) - greatest(p."start", bs-9000) + 1 >= 2
  where peak_id not in (select region_id from t1) and peak_id not in (select region_id from t2))
select *, 1 tier from t1 union all select *, 2 from t2 union all select *, 3 from t3"""))
def great_links(v):
    return L.link_three_tier(v.regions(), v.genes(), 3000, 500, 9000)


@query("domain_links", with_views("peaks annotation", """
select distinct gene, peak_id region_id from peaks p join annotation d on p.chrom=d.chrom
  and p."start" <= d."end" and d."start" <= p."end" where type='exon'"""))
def domain_links(v):
    return L.link_by_domains(v.regions(), v.annotation().filter("type = 'exon'"))


@query("link_support", with_views("peaks annotation", """
select gene, peak_id region_id, count(*) n_hits from peaks p join annotation d on p.chrom=d.chrom
  and p."start" <= d."end" and d."start" <= p."end" group by 1, 2"""))
def link_support(v):
    hits = I.overlap_join(v.regions(), v.annotation().select("chrom", "start", "end", "gene"))
    return L.collapse_links(hits)


_INITIATED = ("ex as (select * from annotation where type='exon'), " + _merged("ex") + """,
h as (select p.chrom, peak_id, p."start" s, p."end" e, m."start" cs, m."end" ce from peaks p
  join ex_m m on p.chrom=m.chrom and p."start"<=m."end" and m."start"<=p."end"
  union all select chrom, peak_id, "start", "end", "end"+1, null from peaks),
g as (select chrom, peak_id, greatest(coalesce(lag(ce) over (partition by peak_id order by cs)+1, s), s) lo,
  least(cs-1, e) hi from h)
select concat(chrom, '-', lo, '-', hi) region_id, chrom, lo as "start", hi as "end", peak_id
from g where lo <= hi""")
#: The views from candidate regions without exons on: they take the place of the peaks.
WITHOUT_EXONS = {
    "peaks_": (SQL_VIEWS["peaks"], []), "acc_": (SQL_VIEWS["acc"], []), "hits_": (SQL_VIEWS["motif_hits"], []),
    "regions_": ("with " + _INITIATED.replace("from peaks", "from peaks_"), ["peaks_", "annotation"]),
    "peaks": ('select region_id peak_id, chrom, "start", "end" from regions_', ["regions_"]),
    "acc": ("select cell, region_id feature, value from acc_ join regions_ on peak_id=feature", ["acc_", "regions_"]),
    "motif_hits": ("select r.region_id, motif from hits_ h join regions_ r on r.peak_id=h.region_id", ["hits_", "regions_"]),
}


@query("initiate_regions", with_views("peaks annotation", "+with " + _INITIATED))
def initiate_regions(v):
    return R.initiate_regions(v.peaks(), v.annotation())


def _conserved(v: Views):
    """Supplied regions: one of 81 bases for each supplier, most of them within a peak."""
    at = (F.col("s_suppkey") % 50) * 1000 + F.floor(F.abs("s_acctbal")) % 200
    return v.table("supplier").select(
        F.concat(F.lit("chr"), (F.col("s_suppkey") % 5).cast("string")).alias("chrom"),
        at.cast("bigint").alias("start"), (at + 80).cast("bigint").alias("end"))


_HEAD, _, _LAST = _INITIATED.replace("from peaks", "from pieces").rpartition("\nselect ")


@query("initiate_conserved_regions", with_views("peaks annotation", f"""+with
conserved as (select concat('chr', s_suppkey%5) chrom, s_suppkey%50*1000+cast(floor(abs(s_acctbal)) as bigint)%200 a
  from supplier),
pieces as (select distinct concat(peak_id, '|', greatest(a, "start"), '|', least(a+80, "end")) peak_id, p.chrom,
  greatest(a, "start") as "start", least(a+80, "end") as "end" from peaks p join conserved c
    on c.chrom=p.chrom and a <= "end" and a+80 >= "start"),
{_HEAD}
select distinct region_id, chrom, "start", "end", split_part(peak_id, '|', 1) peak_id from (select {_LAST}) q"""))
def initiate_conserved_regions(v):
    return R.initiate_regions(v.peaks(), v.annotation(), regions=_conserved(v))


@query("exon_features", with_views("annotation", """
select gene, chrom, "start", "end" from annotation where type='exon'"""))
def exon_features(v):
    return v.annotation().filter("type = 'exon'").select("gene", "chrom", "start", "end")


@query("region_accessibility", with_views("acc peaks", """
select feature region_id, count(*) n_cells, round(sum(value), 6)+0.0 total
from acc join peaks on feature=peak_id group by 1"""))
def region_accessibility(v):
    return (R.region_accessibility(v.acc(), v.regions())
            .groupBy(F.col("feature").alias("region_id"))
            .agg(F.count(F.lit(1)).alias("n_cells"), r6(F.sum("value")).alias("total")))


@query("tfs_use", with_views("motif_tf features", """
select motif, tf from motif_tf where tf in (select feature from features)"""))
def tfs_use(v):
    return R.measured_tfs(v.motif_tf(), v.features())


@query("region_tfs", with_views("region_tf", "select region_id, tf from region_tf"))
def region_tfs(v):
    return R.region_tfs(v.motif_hits(), v.motif_tf())


@query("usable_regions", with_views("peaks links motif_hits", """
select peak_id region_id, chrom, "start", "end" from peaks
where peak_id in (select region_id from links) and peak_id in (select region_id from motif_hits)"""))
def usable_regions(v):
    links = L.link_by_distance(v.regions(), v.genes(), 10000, 0)
    return R.usable_regions(v.regions(), links, v.motif_hits()).select(
        "region_id", "chrom", "start", "end")


# Three small scoring matrices (rows A, C, G, T; one column per position).
PWM_SCORES = {
    "ACT": {"A": [8, -9, -4], "C": [-7, 9, -3], "G": [-9, -6, -8], "T": [-5, -8, 7]},
    "GATA": {"A": [-8, 9, -7, 6], "C": [-9, -8, -6, -3], "G": [9, -7, -9, 2], "T": [-6, -9, 9, -8]},
    "CACTA": {"A": [-7, 7, -8, -4, 8], "C": [8, -9, 7, -5, -6], "G": [-8, -4, -6, -7, -9],
              "T": [-5, -8, -9, 8, -3]},
}


def pwm_table(spark):
    rows = [(m, p, b, s) for m, d in PWM_SCORES.items() for b, ss in d.items()
            for p, s in enumerate(ss)]
    return spark.createDataFrame(rows, "motif string, pos int, base string, score int")


def _pwm_values() -> str:
    rows = [f"('{m}',{p},'{b}',{s})" for m, d in PWM_SCORES.items() for b, ss in d.items()
            for p, s in enumerate(ss)]
    return ", ".join(rows)


_WINDOWS = f"""+with pwm(motif, pos, base, score) as (values {_pwm_values()}),
both_strands as (select motif, pos, base, score, 1 strand from pwm union all
  select p.motif, w - 1 - pos, translate(base, 'ACGT', 'TGCA'), score, -1 from pwm p
  join (select motif, max(pos)+1 w from pwm group by 1) l using (motif)),
grams as (select doc_id, w, substr(seq, i, w) gram, count(*) c from (
  select doc_id, seq, w, unnest(range(1, length(seq) - w + 2)) i from sequences,
    (select distinct max(pos)+1 w from pwm group by motif) where length(seq) >= w)
  group by all),
words as (select distinct gram, w from grams),
scored as (select gram, motif, strand, sum(score) score from words
  join (select motif, max(pos)+1 w from pwm group by 1) l using (w)
  join both_strands b using (motif) where b.base = substr(gram, b.pos + 1, 1) group by all)"""


@query("motif_hits", with_views("sequences", _WINDOWS + """
select doc_id region_id, motif, cast(max(score) as bigint) score from grams join scored using (gram)
group by 1, 2 having max(score) >= 12"""))
def motif_hits(v):
    seqs = v.sequences().withColumnRenamed("doc_id", "region_id")
    cut = v.spark.createDataFrame([(m, 12) for m in PWM_SCORES], "motif string, threshold long")
    return M.find_hits(seqs, pwm_table(v.spark), cut)


@query("motif_thresholds", with_views("sequences", _WINDOWS + """,
hist as (select motif, score, sum(c) n from grams join scored using (gram) group by 1, 2),
tails as (select motif, score, sum(n) over (partition by motif order by score desc) /
  sum(n) over (partition by motif) tail from hist)
select motif, cast(coalesce(min(case when tail <= 0.01 then score end), max(score)+1) as bigint) threshold
from tails group by 1"""))
def motif_thresholds(v):
    return M.score_thresholds(v.sequences(), pwm_table(v.spark), 0.01)
