"""Interval algebra on ``chrom, start, end[, strand]`` columns.

Coordinates are 1-based and closed. Two intervals overlap when they share at
least one position.

The overlap join is an equi-join on hierarchical tiles. Every interval has a
level: the finest tile size that is not smaller than the interval, so it
touches at most two tiles of its own level. A pair meets on exactly one level,
the coarser of the two, and only in the pair's first common tile; nothing has
to be de-duplicated and no interval is ever split into thousands of tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.session import cut_lineage

_BASE_BITS = 7       # finest tile: 128 positions
_STEP_BITS = 3       # each level is 8 times coarser
_MAX_LEVEL = 14
_TILE_BITS = 16      # tile of the merge windows: 65,536 positions


def _level(start: Column, end: Column) -> Column:
    width = (end - start + 1).cast("double")
    raw = F.ceil((F.log2(width) - F.lit(float(_BASE_BITS))) / F.lit(float(_STEP_BITS)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(_MAX_LEVEL)).cast("int")


def _tile(pos: Column, level: Column) -> Column:
    return F.call_function("shiftright", pos.cast("bigint"), level * _STEP_BITS + _BASE_BITS)


def _levels_present(df: DataFrame) -> Column:
    return df.select(_level(F.col("start"), F.col("end")).alias("lv")).agg(
        F.collect_set("lv").alias("lvs")).scalar()


def _spread(df: DataFrame, other_levels: Column, tag: str) -> DataFrame:
    """One row per (level, tile) on which this interval can meet the other side."""
    own, lvs = F.col(f"{tag}own"), F.col(f"{tag}lvs")
    df = df.withColumn(f"{tag}own", _level(F.col(f"{tag}start"), F.col(f"{tag}end")))
    df = df.withColumn(f"{tag}lvs", other_levels)
    wanted = F.filter(
        F.sequence(own, F.lit(_MAX_LEVEL)),
        lambda v: F.array_contains(lvs, v) | ((v == own) & (F.array_min(lvs) <= own)),
    )
    df = df.withColumn("level", F.explode(wanted)).drop(f"{tag}lvs")
    first = _tile(F.col(f"{tag}start"), F.col("level"))
    last = _tile(F.col(f"{tag}end"), F.col("level"))
    df = df.withColumn(f"{tag}first", first)
    return df.withColumn("tile", F.explode(F.sequence(F.col(f"{tag}first"), last)))


def _dense_tiles(l: DataFrame, r: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``(*keys, parts, spread)`` of tiles with more than ``most`` pairs; ``spread`` tells whether the left is larger."""
    counts = [d.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(n)) for d, n in ((l, "nl"), (r, "nr"))]
    parts = F.ceil(F.col("nl") * F.col("nr") / most)
    return (counts[0].join(counts[1], keys)
            .select(*keys, F.least(parts, F.greatest("nl", "nr")).cast("int").alias("parts"),
                    (F.col("nl") >= F.col("nr")).alias("spread"))
            .filter("parts > 1"))


def _dealt(df: DataFrame, dense: DataFrame, keys: list[str], left: bool) -> DataFrame:
    """Deal the rows of a dense tile to its parts, or repeat them for each if theirs is the smaller side."""
    d = df.join(dense, keys, "left")
    mine = F.col("spread") if left else ~F.col("spread")
    own = F.pmod(F.xxhash64(*df.columns), F.col("parts")).cast("int")
    salts = (F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(mine, F.array(own))
             .otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    return d.withColumn("salt", F.explode(salts)).drop("parts", "spread")


def overlap_join(left: DataFrame, right: DataFrame, min_overlap: int = 1,
                 most: int | None = 1 << 33) -> DataFrame:
    """All overlapping pairs.

    Result columns: ``chrom, l_start, l_end, r_start, r_end, width`` plus the
    remaining columns of both inputs, whose names must differ. Rows travel once
    for each tile they can meet in. Only a tile with more than ``most`` pairs of
    rows is dealt to several tasks: its larger side is split, its smaller one
    repeated. Both sides are shuffled: the planner's size of a side leaves out
    the tiles, and a broadcast of it would be built in the driver.
    """
    l = left.withColumnsRenamed({"start": "l_start", "end": "l_end"})
    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    l = _spread(l, _levels_present(right), "l_")
    r = _spread(r, _levels_present(left), "r_")
    keys = ["chrom", "level", "tile"]
    if most is not None:
        dense = cut_lineage(_dense_tiles(l, r, keys, most))
        if not dense.isEmpty():
            l, r = _dealt(l, dense, keys, True), _dealt(r, dense, keys, False)
            keys = [*keys, "salt"]
    l, r = l.drop("l_first"), r.drop("r_first")      # known from the start and the level
    width = (F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1).alias("width")
    joined = l.join(r.hint("merge"), keys).filter(
        (F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1 >= min_overlap)
        & (F.col("tile") == _tile(F.greatest("l_start", "r_start"), F.col("level")))
        & (F.col("level") == F.greatest("l_own", "r_own"))
    )
    lpay = [c for c in left.columns if c not in ("chrom", "start", "end")]
    rpay = [c for c in right.columns if c not in ("chrom", "start", "end")]
    return joined.select("chrom", "l_start", "l_end", "r_start", "r_end", width, *lpay, *rpay)


def strands_match(a: str, b: str) -> Column:
    """``*`` is compatible with either strand."""
    return (F.col(a) == "*") | (F.col(b) == "*") | (F.col(a) == F.col(b))


def pair_intersection(pairs: DataFrame) -> DataFrame:
    """Replace both members of overlapping pairs by their common part."""
    return (
        pairs.withColumns({"start": F.greatest("l_start", "r_start"),
                           "end": F.least("l_end", "r_end")})
        .drop("l_start", "l_end", "r_start", "r_end", "width")
    )


def merge_intervals(df: DataFrame, keys=("chrom",), gap: int = 1) -> DataFrame:
    """Union of intervals per key as disjoint pieces.

    Intervals that overlap or are adjacent (``gap=1``) become one. Running
    maxima are taken inside tiles of 65,536 start positions and carried over
    tile by tile, so no window spans a whole chromosome of rows: a tile holds at
    most one row per start position, and the carry has one row per tile.
    """
    keys = list(keys)
    starts = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    starts = starts.withColumn("tile", F.shiftright("start", _TILE_BITS))
    per_tile = starts.groupBy(*keys, "tile").agg(F.max("end").alias("tile_max"))
    before = W.partitionBy(*keys).orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    carry = per_tile.select(*keys, "tile", F.max("tile_max").over(before).alias("carry"))

    in_tile = W.partitionBy(*keys, "tile").orderBy("start")
    reach = F.greatest(
        F.max("end").over(in_tile.rowsBetween(W.unboundedPreceding, -1)), F.col("carry"))
    marked = (
        starts.join(carry, [*keys, "tile"])
        .withColumn("reach", reach)
        .withColumn("opens", F.when(
            F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), 1).otherwise(0))
    )
    opened = marked.groupBy(*keys, "tile").agg(F.sum("opens").alias("n_open"))
    offset = opened.select(
        *keys, "tile", F.coalesce(F.sum("n_open").over(before), F.lit(0)).alias("offset"))
    local = F.sum("opens").over(in_tile.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        marked.withColumn("local", local).join(offset, [*keys, "tile"])
        .groupBy(*keys, (F.col("local") + F.col("offset")).alias("island"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def within_one(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of ``df`` that lie whole in one of ``regions``.

    The farthest end of the regions that start no later decides; it is a running
    maximum inside tiles, carried over tile by tile, so no pairs are formed.
    """
    far = regions.groupBy("chrom", "start").agg(F.max("end").alias("_far")).withColumn("_row", F.lit(False))
    rows = df.withColumn("_row", F.lit(True)).unionByName(far, allowMissingColumns=True)
    rows = rows.withColumn("tile", F.shiftright("start", _TILE_BITS))
    before = W.partitionBy("chrom").orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    carry = (far.groupBy("chrom", F.shiftright("start", _TILE_BITS).alias("tile")).agg(F.max("_far").alias("tile_max"))
             .unionByName(df.select("chrom", F.shiftright("start", _TILE_BITS).alias("tile"), F.lit(None).alias("tile_max")))
             .groupBy("chrom", "tile").agg(F.max("tile_max").alias("tile_max"))
             .select("chrom", "tile", F.max("tile_max").over(before).alias("carry")))
    here = W.partitionBy("chrom", "tile").orderBy("start", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.join(carry, ["chrom", "tile"]).withColumn("reach", F.greatest(F.max("_far").over(here), "carry"))
            .filter(F.col("_row") & (F.col("start") <= F.col("end")) & (F.col("reach") >= F.col("end")))
            .select(*df.columns))


def union_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = ["chrom", "start", "end"]
    return merge_intervals(a.select(*cols).unionByName(b.select(*cols)))


def intersect_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions covered by both sets, as disjoint pieces."""
    cols = ["chrom", "start", "end"]
    # The overlap join reads each side twice (tile levels first), so keep the results.
    left, right = (cut_lineage(merge_intervals(d.select(*cols))) for d in (a, b))
    pairs = overlap_join(left, right)
    return merge_intervals(pair_intersection(pairs))


def subtract_intervals(df: DataFrame, holes: DataFrame, id_col: str) -> DataFrame:
    """Cut ``holes`` out of every row of ``df``; a row may give 0..k pieces.

    ``holes`` must be disjoint (see :func:`merge_intervals`). One sentinel hole
    behind the end of every row makes the last piece an ordinary gap.
    """
    payload = [c for c in df.columns if c not in ("start", "end")]
    holes = cut_lineage(holes)
    hits = overlap_join(df, holes.select("chrom", "start", "end"))
    cuts = hits.select(*payload, F.col("l_start").alias("start"), F.col("l_end").alias("end"),
                       F.col("r_start").alias("cut_start"), F.col("r_end").alias("cut_end"))
    tails = df.select(*payload, "start", "end", (F.col("end") + 1).alias("cut_start"),
                      F.lit(None).cast("bigint").alias("cut_end"))
    w = W.partitionBy(id_col).orderBy("cut_start")
    lo = F.coalesce(F.greatest(F.lag("cut_end").over(w) + 1, F.col("start")), F.col("start"))
    return (
        cuts.unionByName(tails)
        .withColumn("lo", lo)
        .withColumn("hi", F.least(F.col("cut_start") - 1, F.col("end")))
        .filter("lo <= hi")
        .select(*payload, F.col("lo").alias("start"), F.col("hi").alias("end"))
    )


def extend_intervals(df: DataFrame, upstream: int = 0, downstream: int = 0) -> DataFrame:
    """Strand-aware extension; ``*`` is treated as ``+``."""
    minus = F.col("strand") == "-"
    return df.withColumns({
        "start": F.col("start") - F.when(minus, F.lit(downstream)).otherwise(F.lit(upstream)),
        "end": F.col("end") + F.when(minus, F.lit(upstream)).otherwise(F.lit(downstream)),
    })


def to_tss(df: DataFrame) -> DataFrame:
    """Shrink to the first transcribed position."""
    pos = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    return df.withColumns({"start": pos, "end": pos})
