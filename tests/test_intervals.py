import numpy as np
import pytest
from pyspark.sql import functions as F

from regweave.operators import intervals as I
from regweave.operators import links as L
from regweave.plans import regions as R

PEAKS = [("p1", "chr1", 10, 15), ("p2", "chr1", 20, 22), ("p3", "chr1", 30, 33),
         ("p4", "chr1", 40, 45), ("p5", "chr1", 45, 46)]
PLUS = [("A", "chr1", 1, 8, "+"), ("B", "chr1", 25, 30, "+"), ("C", "chr1", 30, 40, "+")]
MINUS = [("A", "chr1", 1, 8, "-"), ("B", "chr1", 20, 30, "-"), ("C", "chr1", 30, 40, "-")]


def _regions(spark):
    return spark.createDataFrame(PEAKS, "region_id string, chrom string, start long, end long")


def _genes(spark, rows):
    return spark.createDataFrame(
        rows, "gene string, chrom string, start long, end long, strand string")


@pytest.mark.parametrize("rows,tss,expected", [
    (MINUS, False, {"A": "p1", "B": "p1 p2 p3", "C": "p3 p4 p5"}),
    (PLUS, False, {"A": "p1", "B": "p2 p3", "C": "p3 p4 p5"}),
    (PLUS, True, {"B": "p2 p3", "C": "p3"}),
    (MINUS, True, {"A": "p1", "B": "p3", "C": "p4 p5"}),
])
def test_linking_matrices(spark, rows, tss, expected):
    got = L.link_by_distance(_regions(spark), _genes(spark, rows), 5, 5, tss).collect()
    want = {(g, p) for g, ps in expected.items() for p in ps.split()}
    assert {(r["gene"], r["region_id"]) for r in got} == want


def _random(spark, n, seed, name, widths):
    rng = np.random.default_rng(seed)
    start = rng.integers(1, 200_000, n)
    width = rng.choice(widths, n)
    chrom = np.where(rng.random(n) < 0.6, "a", "b")     # one chromosome holds most rows
    rows = [(int(i), str(c), int(s), int(s + w)) for i, (c, s, w)
            in enumerate(zip(chrom, start, width))]
    return rows, spark.createDataFrame(rows, f"{name} long, chrom string, start long, end long")


@pytest.mark.parametrize("min_overlap", [1, 2, 50])
def test_overlap_join_against_brute_force(spark, min_overlap):
    ra, a = _random(spark, 300, 1, "ia", [0, 1, 40, 3000])
    rb, b = _random(spark, 200, 2, "ib", [0, 90, 20_000, 150_000])
    got = I.overlap_join(a, b, min_overlap).select("ia", "ib").collect()
    want = {(x[0], y[0]) for x in ra for y in rb if x[1] == y[1]
            and min(x[3], y[3]) - max(x[2], y[2]) + 1 >= min_overlap}
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want


def _positions(rows):
    out = set()
    for c, s, e in rows:
        out.update((c, p) for p in range(s, e + 1))
    return out


def test_set_operations_cover_the_right_positions(spark):
    ra, a = _random(spark, 60, 3, "ia", [0, 10, 500])
    rb, b = _random(spark, 60, 4, "ib", [5, 900])
    pa, pb = (_positions([r[1:] for r in x]) for x in (ra, rb))
    cols = ["chrom", "start", "end"]

    def got(d):
        rows = [tuple(r) for r in d.select(*cols).collect()]
        pos = _positions(rows)
        assert sum(e - s + 1 for _, s, e in rows) == len(pos)      # disjoint pieces
        return pos
    assert got(I.merge_intervals(a.select(*cols))) == pa
    assert got(I.union_intervals(a, b)) == pa | pb
    assert got(I.intersect_intervals(a, b)) == pa & pb
    one = I.subtract_intervals(a, I.merge_intervals(b.select(*cols)), "ia")
    for r in one.collect():
        assert not _positions([(r["chrom"], r["start"], r["end"])]) & pb
    assert _positions([tuple(r) for r in one.select(*cols).collect()]) == pa - pb


def test_merge_joins_adjacent_intervals_across_tiles(spark):
    rows = [("c", 1, 65_535), ("c", 65_536, 70_000), ("c", 70_001, 70_001), ("c", 70_003, 70_004)]
    d = spark.createDataFrame(rows, "chrom string, start long, end long")
    got = sorted(tuple(r) for r in I.merge_intervals(d).select("chrom", "start", "end").collect())
    assert got == [("c", 1, 70_001), ("c", 70_003, 70_004)]


def test_three_tiers_stop_at_the_first_match(spark):
    regions = spark.createDataFrame(
        [("in_basal", "c", 95, 99), ("far", "c", 2000, 2010), ("lost", "c", 90_000, 90_010),
         ("one_base", "c", 1001, 1001)],
        "region_id string, chrom string, start long, end long")
    genes = _genes(spark, [("G", "c", 100, 1000, "+")])
    got = {(r["region_id"], r["tier"]) for r in L.link_three_tier(
        regions, genes, upstream=50, downstream=0, extend=5000).collect()}
    assert got == {("in_basal", 1), ("far", 3)}
    tss = {(r["region_id"], r["tier"]) for r in L.link_three_tier(
        regions.unionByName(spark.createDataFrame([("body", "c", 500, 510)], regions.schema)),
        genes, 50, 0, 5000, basal="tss").collect()}
    assert tss == {("in_basal", 1), ("body", 2), ("far", 3)}


def test_initiate_regions_keeps_parent_peaks(spark):
    peaks = spark.createDataFrame(
        [("c-100-200", "c", 100, 200), ("c-150-300", "c", 150, 300)],
        "peak_id string, chrom string, start long, end long")
    ann = spark.createDataFrame(
        [("G", "exon", "c", 120, 130, "+"), ("G", "exon", "c", 125, 160, "-"),
         ("G", "gene", "c", 1, 1000, "+")],
        "gene string, type string, chrom string, start long, end long, strand string")
    got = {(r["region_id"], r["peak_id"]) for r in R.initiate_regions(peaks, ann).collect()}
    assert got == {("c-100-119", "c-100-200"), ("c-161-200", "c-100-200"),
                   ("c-161-300", "c-150-300")}
    cons = spark.createDataFrame([("c", 190, 210)], "chrom string, start long, end long")
    got = {(r["region_id"], r["peak_id"]) for r in R.initiate_regions(
        peaks, ann, cons, exclude_exons=False).collect()}
    assert got == {("c-190-200", "c-100-200"), ("c-190-210", "c-150-300")}


def test_extension_and_names(spark):
    g = _genes(spark, [("A", "chr-1", 100, 200, "+"), ("B", "chr-1", 100, 200, "-"),
                       ("C", "chr-1", 100, 200, "*")])
    got = {r["gene"]: (r["start"], r["end"]) for r in I.extend_intervals(g, 30, 5).collect()}
    assert got == {"A": (70, 205), "B": (95, 230), "C": (70, 205)}
    from regweave.functions.columns import region_name, split_region
    d = split_region(g.select(region_name(sep=(":", "_")).alias("n")).distinct(), "n", (":", "_"))
    assert tuple(d.first()) == ("chr-1:100_200", "chr-1", 100, 200)
    assert I.to_tss(g).filter(F.col("gene") == "B").first()["start"] == 200


def test_overlap_join_sends_no_repeated_side_through_the_driver(spark):
    _, a = _random(spark, 300, 1, "ia", [0, 1, 40, 3000])
    _, b = _random(spark, 200, 2, "ib", [0, 90, 20_000, 150_000])
    plan = I.overlap_join(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_equal_regions_are_joined_once(spark):
    peaks = spark.createDataFrame([("p", "chr1", 10, 50)], "peak_id string, chrom string, start long, end long")
    regions = spark.createDataFrame([("chr1", 20, 30)] * 5 + [("chr1", 40, 70)], "chrom string, start long, end long")
    seen = []
    join = R.overlap_join
    try:
        R.overlap_join = lambda l, r, *k: seen.append(r.count()) or join(l, r, *k)
        got = {tuple(r) for r in R.candidate_regions(peaks, regions).select("peak_id", "start", "end").collect()}
    finally:
        R.overlap_join = join
    assert seen == [2] and got == {("p", 20, 30), ("p", 40, 50)}


@pytest.mark.parametrize("most", [None, 40, 1])
def test_dense_tiles_are_dealt_to_parts(spark, most):
    ra, a = _random(spark, 150, 5, "ia", [0, 40, 3000])
    rb, b = _random(spark, 200, 6, "ib", [0, 90, 20_000])
    got = I.overlap_join(a, b, most=most).select("ia", "ib").collect()
    want = {(x[0], y[0]) for x in ra for y in rb if x[1] == y[1] and min(x[3], y[3]) >= max(x[2], y[2])}
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want


def test_rows_travel_once_where_no_tile_is_dense(spark):
    rows = [(i, "c", 1000 * i, 1000 * i + 5) for i in range(50)]
    a, b = (spark.createDataFrame(rows, f"{n} long, chrom string, start long, end long") for n in ("ia", "ib"))
    plan = I.overlap_join(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" not in plan and "sequence(0, 7" not in plan


def test_candidate_regions_compare_no_pairs(spark):
    rng = np.random.default_rng(8)
    peaks = [(f"p{i}", "cd"[i % 2], s, s + int(rng.integers(0, 12))) for i, s in enumerate(map(int, rng.integers(0, 60, 50)))]
    peaks += [("twice", "c", 5, 20), ("twice", "c", 10, 30), ("far", "c", 200_000, 200_004), peaks[0]]
    regions = [("cd"[i % 2], s, s + int(rng.integers(0, 12))) for i, s in enumerate(map(int, rng.integers(0, 60, 200)))]
    regions += [("c", 100, 300_000), ("c", 3, 40)]
    p = spark.createDataFrame(peaks, "peak_id string, chrom string, start long, end long")
    r = spark.createDataFrame(regions, "chrom string, start long, end long")
    got = sorted(map(tuple, R.candidate_regions(p, r).select("peak_id", "chrom", "start", "end").collect()))
    want = {(i, c, max(s, a), min(e, b)) for i, c, s, e in peaks for d, a, b in regions if c == d and max(s, a) <= min(e, b)}
    assert got == sorted(want)
    plan = R.candidate_regions(p.filter("peak_id like 'p%'"), r)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join Inner")[0]      # nothing is grouped above the pairs
