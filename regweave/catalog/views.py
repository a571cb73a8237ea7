"""Study-shaped views over the given tables, in Spark and as SQL text.

The same definitions exist twice: as DataFrames for the registered queries and
as common table expressions for their SQL counterparts. All tables are read
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regweave.operators.modules import find_modules
from regweave.session import cut_lineage


def r6(c) -> Column:
    """Rounded for comparison across engines; the sum removes negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


# Thresholds of the module view.
P_THRESH, RSQ_THRESH, NVAR_THRESH, MIN_GENES = 0.015, 0.45, 25, 5


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        # Epoch seconds of event times must not depend on the machine's zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def cells(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("pool"),
            F.col("c_nationkey").alias("batch"))

    def _sales(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        o = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
        p = self.table("part").select("p_partkey", "p_brand", "p_size")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(p, F.col("l_partkey") == F.col("p_partkey")))

    def expr(self) -> DataFrame:
        return self._sales().groupBy("cell", F.col("p_brand").alias("feature")).agg(
            F.sum("l_quantity").alias("value"))

    def acc(self) -> DataFrame:
        d = self._sales().groupBy("cell", "p_size").agg(
            F.count(F.lit(1)).cast("double").alias("value"))
        return d.select("cell", _peak_name().alias("feature"), "value")

    def assays(self) -> tuple[DataFrame, DataFrame]:
        """``expr`` and ``acc`` from one pass over the sales, stored as one table.

        The sales travel once, by cell; both sums of a cell are made where its sales are.
        """
        brand, size = F.col("p_brand").alias("brand"), F.col("p_size").alias("size")
        none = [F.lit(None).cast(t) for t in ("string", "int")]
        sums = (self._sales().select("cell", "p_brand", "p_size", "l_quantity").repartition("cell")
                .select("cell", F.inline(F.array(
                    F.struct(F.lit(True).alias("first"), brand, none[1].alias("size"), F.col("l_quantity").alias("v")),
                    F.struct(F.lit(False).alias("first"), none[0].alias("brand"), size, F.lit(1.0).alias("v")))))
                .groupBy("cell", "first", "brand", "size").agg(F.sum("v").alias("value")))
        name = F.when(F.col("first"), F.col("brand")).otherwise(_peak_name("size"))
        both = cut_lineage(sums.select("cell", "first", name.alias("feature"), "value"))
        return both.filter("first").drop("first"), both.filter("not first").drop("first")

    def features(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("feature")).distinct().withColumn(
            "is_variable", F.lit(True))

    def peaks(self) -> DataFrame:
        return (self.table("part").select("p_size").distinct()
                .select(_peak_name().alias("peak_id"), *_peak_span()))

    def genes(self) -> DataFrame:
        return self.annotation().filter("type = 'gene'")

    def annotation(self) -> DataFrame:
        p = self.table("part").select(
            F.col("p_brand").alias("gene"), F.substr(F.col("p_brand"), F.lit(7)).cast("int").alias("n"),
            "p_size").distinct()
        chrom = F.concat(F.lit("chr"), (F.col("n") % 5).cast("string")).alias("chrom")
        strand = F.when(F.col("n") % 2 == 0, "+").otherwise("-").alias("strand")
        gid = F.concat(F.lit("G"), F.col("n").cast("string")).alias("gene_id")
        gene = p.select("gene", "n").distinct().select(
            "gene", gid, F.lit("gene").alias("type"), chrom,
            (F.col("n") * 2000).cast("bigint").alias("start"),
            (F.col("n") * 2000 + 500).cast("bigint").alias("end"), strand)
        at = F.col("n") * 2000 + (F.col("p_size") % 3) * 1000 + F.col("p_size") * 7
        exon = p.select("gene", gid, F.lit("exon").alias("type"), chrom,
                        at.cast("bigint").alias("start"), (at + 40).cast("bigint").alias("end"),
                        strand)
        return gene.unionByName(exon)

    def motif_hits(self) -> DataFrame:
        """A motif is present where its parts are priced above the overall mean."""
        p = self.table("part")
        dime = F.round(F.col("p_retailprice") * 10).cast("bigint")
        tot = p.agg(F.struct(F.sum(dime).alias("s"), F.count(F.lit(1)).alias("n")).alias("t")).scalar()
        d = (p.groupBy("p_size", F.col("p_type").alias("motif"))
             .agg(F.sum(dime).alias("s"), F.count(F.lit(1)).alias("c")).withColumn("t", tot))
        return (d.filter(F.col("s") * F.col("t.n") >= F.col("t.s") * F.col("c"))
                .select(_peak_name().alias("region_id"), "motif"))

    def motif_tf(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_type").alias("motif"), F.col("p_brand").alias("tf")).distinct()

    def regions(self) -> DataFrame:
        return self.peaks().withColumn("region_id", F.col("peak_id"))

    def intervals(self) -> DataFrame:
        at = F.unix_timestamp("ts")
        return self.table("events").select(
            "event_id", "event_type", (F.col("user_id") % 5).cast("string").alias("chrom"),
            at.alias("start"), (at + F.floor("value") * 60).cast("bigint").alias("end"),
            F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"))

    def pvals(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "event_type", (F.col("value") / F.lit(500.0)).alias("pval"))

    def coefs(self) -> DataFrame:
        li = self.table("lineitem").groupBy("l_suppkey", "l_partkey", "l_linenumber").agg(
            F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"),
            F.sum("l_quantity").alias("q"))
        lo = F.col("l_linenumber") * 100
        region = F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string"), F.lit("-"),
                          (lo + 1).cast("string"), F.lit("-"), (lo + 80).cast("string"))
        return li.select(
            F.concat(F.lit("N"), F.col("l_suppkey").cast("string")).alias("tf"),
            F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("target"),
            region.alias("region"), r6(F.col("d") - 0.05).alias("estimate"),
            r6("t").alias("pval"), r6("t").alias("padj"), F.col("q").alias("gain"))

    def gof(self) -> DataFrame:
        return (self.table("lineitem").groupBy("l_partkey")
                .agg(F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("nvariables"))
                .select(F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("target"),
                        r6(F.col("d") * 12 - 0.1).alias("rsq"), "nvariables"))

    def modules(self, counts: bool = True) -> DataFrame:
        d = find_modules(self.coefs(), self.gof(), "glm", counts, p_thresh=P_THRESH,
                         rsq_thresh=RSQ_THRESH, nvar_thresh=NVAR_THRESH)
        # Estimates that cancel out must be exactly zero on both engines.
        return d.withColumn("estimate", r6("estimate"))

    def sequences(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))

    def module_regions(self) -> DataFrame:
        """Parent peaks of the regions named in coefficients."""
        r = self.coefs().select(F.col("region").alias("region_id")).distinct()
        chrom = F.substring_index("region_id", "-", 1)
        return r.select("region_id", F.concat(chrom, F.lit("-1-1000")).alias("peak_id"))


def _peak_name(size: str = "p_size") -> Column:
    s = F.col(size)
    return F.concat(F.lit("chr"), (s % 5).cast("string"), F.lit("-"), (s * 1000).cast("string"),
                    F.lit("-"), (s * 1000 + 200 + (s % 7) * 10).cast("string"))


def _peak_span() -> list[Column]:
    s = F.col("p_size")
    return [F.concat(F.lit("chr"), (s % 5).cast("string")).alias("chrom"),
            (s * 1000).cast("bigint").alias("start"),
            (s * 1000 + 200 + (s % 7) * 10).cast("bigint").alias("end")]


_PEAK = ("concat('chr', cast(p_size%5 as varchar), '-', cast(1000*p_size as varchar), '-', "
         "cast(1000*p_size+200+10*(p_size%7) as varchar))")

SQL_VIEWS = {
    "cells": "select c_custkey cell, c_mktsegment pool, c_nationkey batch from customer",
    "expr": """select o_custkey cell, p_brand feature, sum(l_quantity) as value
        from lineitem join orders on l_orderkey=o_orderkey join part on p_partkey=l_partkey
        group by 1, 2""",
    "acc": f"""select o_custkey cell, {_PEAK} feature, cast(count(*) as double) as value
        from lineitem join orders on l_orderkey=o_orderkey join part on p_partkey=l_partkey
        group by 1, 2""",
    "features": "select distinct p_brand feature from part",
    "peaks": f"""select distinct {_PEAK} peak_id, concat('chr', cast(p_size%5 as varchar)) chrom,
        cast(1000*p_size as bigint) as "start",
        cast(1000*p_size+200+10*(p_size%7) as bigint) as "end" from part""",
    "annotation": """with b as (select distinct p_brand gene,
            cast(substr(p_brand,7) as int) n, p_size from part)
        select distinct gene, concat('G', cast(n as varchar)) gene_id, 'gene' as type,
            concat('chr', cast(n%5 as varchar)) chrom, cast(2000*n as bigint) as "start",
            cast(2000*n+500 as bigint) as "end",
            case when n%2=0 then '+' else '-' end strand from b
        union all
        select gene, concat('G', cast(n as varchar)), 'exon', concat('chr', cast(n%5 as varchar)),
            cast(2000*n+1000*(p_size%3)+7*p_size as bigint),
            cast(2000*n+1000*(p_size%3)+7*p_size+40 as bigint),
            case when n%2=0 then '+' else '-' end from b""",
    "genes": "select * from annotation where type='gene'",
    "motif_hits": f"""select {_PEAK} region_id, p_type motif from part group by p_size, p_type
        having sum(cast(round(p_retailprice*10) as bigint)) * (select count(*) from part) >=
            (select sum(cast(round(p_retailprice*10) as bigint)) from part) * count(*)""",
    "motif_tf": "select distinct p_type motif, p_brand tf from part",
    "region_tf": "select distinct region_id, tf from motif_hits join motif_tf using (motif)",
    "intervals": """select event_id, event_type, cast(user_id%5 as varchar) chrom,
            cast(floor(epoch(ts)) as bigint) as "start",
            cast(floor(epoch(ts)) as bigint) + 60*cast(floor(value) as bigint) as "end",
            case when user_id%2=0 then '+' else '-' end strand from events""",
    "pvals": "select event_id, event_type, value/500.0 pval from events",
    "coefs": """select concat('N', cast(l_suppkey as varchar)) tf,
            concat('N', cast(l_partkey as varchar)) target,
            concat('chr', cast(l_suppkey%5 as varchar), '-', cast(100*l_linenumber+1 as varchar),
                '-', cast(100*l_linenumber+80 as varchar)) region,
            round(avg(l_discount)-0.05, 6)+0.0 estimate, round(avg(l_tax), 6)+0.0 pval,
            round(avg(l_tax), 6)+0.0 padj, sum(l_quantity) gain
        from lineitem group by l_suppkey, l_partkey, l_linenumber""",
    "gof": """select concat('N', cast(l_partkey as varchar)) target,
            round(avg(l_discount)*12-0.1, 6)+0.0 rsq, count(*) nvariables
        from lineitem group by l_partkey""",
    "kept": f"""select c.* from coefs c join gof g using (target)
        where rsq > {RSQ_THRESH} and nvariables > {NVAR_THRESH} and padj < {P_THRESH}""",
    "modules": """with k as (select *, count(*) over (partition by target) nvars from kept),
        t as (select target, count(distinct region) n_regions, count(distinct tf) n_tfs
              from kept group by target),
        f as (select tf, count(distinct target) n_genes from kept group by tf)
        select k.tf, k.target, round(sum(estimate), 6)+0.0 estimate, any_value(n_regions) n_regions,
            any_value(n_genes) n_genes, any_value(n_tfs) n_tfs,
            string_agg(region, ';' order by region) regions, min(pval) pval, min(padj) padj
        from k join t using (target) join f using (tf) group by k.tf, k.target""",
    "big": f"""select *, case when estimate > 0 then 'pos' else 'neg' end direction
        from modules where estimate <> 0
        qualify count(*) over (partition by tf, case when estimate > 0 then 'pos' else 'neg' end)
            > {MIN_GENES}""",
    "edges": """select tf from_node, target to_node, estimate, regions, padj,
            cast(sign(estimate) as double) dir from modules""",
    "nodes": "select from_node as name from edges union select to_node from edges",
    "sequences": """select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') seq
        from documents""",
    "links": """select distinct gene target, peak_id region_id from peaks p join genes g
        on p.chrom=g.chrom
        and p."start" <= g."end" + case when strand='-' then 10000 else 0 end
        and p."end" >= g."start" - case when strand='-' then 0 else 10000 end""",
    "n": "select cast(count(*) as double) n from cells",
    "emom": "select feature, sum(value) s1, sum(value*value) s2 from expr group by 1",
    "amom": "select feature, sum(value) s1, sum(value*value) s2 from acc group by 1",
    "lcor": """select l.target, l.region_id, coalesce(
            (coalesce(sxy,0) - a.s1*e.s1/n) / nullif(sqrt(greatest(a.s2-a.s1*a.s1/n,0))
            * sqrt(greatest(e.s2-e.s1*e.s1/n,0)), 0), 0) cor
        from links l cross join n join amom a on a.feature=l.region_id
        join emom e on e.feature=l.target
        left join (select x.feature xf, y.feature yf, sum(x.value*y.value) sxy
            from acc x join expr y using (cell) group by 1, 2) s
            on s.xf=l.region_id and s.yf=l.target""",
    "gcor": """select x.feature x, y.feature y, (coalesce(sxy,0) - x.s1*y.s1/n)/(n-1) cov,
            coalesce((coalesce(sxy,0) - x.s1*y.s1/n) / nullif(sqrt(greatest(x.s2-x.s1*x.s1/n,0))
            * sqrt(greatest(y.s2-y.s1*y.s1/n,0)), 0), 0) cor
        from emom x join emom y on x.feature <= y.feature cross join n
        left join (select a.feature xf, b.feature yf, sum(a.value*b.value) sxy
            from expr a join expr b using (cell) group by 1, 2) s
            on s.xf=x.feature and s.yf=y.feature""",
    "cand": """select distinct l.target, l.region_id, tf from (select * from lcor where abs(cor) > 0.02) l
        join region_tf using (region_id) where tf <> target""",
    "tcor": """select c.target, c.tf, g.cor from (select distinct target, tf from cand) c
        join gcor g on g.x=least(c.target,c.tf) and g.y=greatest(c.target,c.tf)""",
    "pairs": """select c.* from cand c join tcor t on t.target=c.target and t.tf=c.tf
        where abs(cor) > 0.1""",
}

_NEEDS = {
    "genes": ["annotation"], "region_tf": ["motif_hits", "motif_tf"],
    "kept": ["coefs", "gof"], "modules": ["kept"], "big": ["modules"], "edges": ["modules"],
    "nodes": ["edges"], "links": ["peaks", "genes"], "n": ["cells"], "emom": ["expr"],
    "amom": ["acc"], "lcor": ["links", "n", "amom", "emom", "acc", "expr"],
    "gcor": ["emom", "n", "expr"], "cand": ["lcor", "region_tf"], "tcor": ["cand", "gcor"],
    "pairs": ["cand", "tcor"],
}

UPSTREAM, PEAK_COR, TF_COR = 10_000, 0.02, 0.1


def with_views(names: str, body: str, changed: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """``body`` behind the definitions of the named views and what they need.

    ``changed`` has other definitions of views, each with the views it needs.
    """
    order: list[str] = []
    texts = {**SQL_VIEWS, **{k: sql for k, (sql, _) in (changed or {}).items()}}
    needs = {**_NEEDS, **{k: v for k, (_, v) in (changed or {}).items()}}

    def visit(v: str) -> None:
        for d in needs.get(v, []):
            visit(d)
        if v not in order:
            order.append(v)
    for v in names.split():
        visit(v)
    ctes = ",\n".join(f"{v} as materialized ({texts[v]})" for v in order)
    extra = body.lstrip()
    if extra.startswith("+with"):
        return f"with recursive {ctes},\n{extra[5:]}"
    return f"with {ctes}\n{extra}"
