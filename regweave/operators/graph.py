"""Directed network analytics on node and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.operators.skew import salted_join
from regweave.session import cut_lineage, discard


def module_graph(modules: DataFrame, features: DataFrame | None = None,
                 corr: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes(name), edges)`` of a module table.

    ``features`` keeps edges with both ends in the set; ``corr(tf, target,
    corr)`` is attached with 0 where missing.
    """
    m = modules
    if features is not None:
        for end in ("tf", "target"):
            m = salted_join(m, features.select(F.col("feature").alias(end)), [end],
                            ["tf", "target"], how="left_semi")
    if corr is not None:
        m = (m.join(corr.select("tf", "target", "corr"), ["tf", "target"], "left")
             .withColumn("corr", F.coalesce("corr", F.lit(0.0))))
    rest = [c for c in m.columns if c not in ("tf", "target")]
    edges = m.select(F.col("tf").alias("from_node"), F.col("target").alias("to_node"),
                     *rest, F.signum("estimate").alias("dir"))
    return graph_nodes(edges), edges


def graph_nodes(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("from_node").alias("name"))
            .unionByName(edges.select(F.col("to_node").alias("name"))).distinct())


def flag_tfs(nodes: DataFrame, motif_tf: DataFrame) -> DataFrame:
    """Mark the nodes that are TFs of the network."""
    tfs = motif_tf.select(F.col("tf").alias("name")).distinct().withColumn("_t", F.lit(True))
    return (nodes.join(tfs, "name", "left")
            .withColumn("is_tf", F.coalesce("_t", F.lit(False))).drop("_t"))


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100,
             tol: float = 1e-9) -> DataFrame:
    """``(name, centrality)``, summing to one.

    Nodes without outgoing edges spread their mass evenly. ``tol=0`` runs exactly
    ``max_iter`` rounds. Edges are salted by their head, so a hub's edges are
    spread over tasks; contributions are added map-side before the shuffle.
    """
    links = cut_lineage(edges.select("from_node", "to_node").distinct())
    deg = links.groupBy("from_node").agg(F.count(F.lit(1)).alias("deg"))
    nodes = cut_lineage(graph_nodes(links).join(
        deg.withColumnRenamed("from_node", "name"), "name", "left"))
    n = nodes.count()
    if n == 0:
        return nodes.select("name", F.lit(0.0).alias("centrality"))
    ranks, kept = nodes.withColumn("rank", F.lit(1.0 / n)), None
    for _ in range(max_iter):
        share = (ranks.filter("deg is not null")
                 .select(F.col("name").alias("from_node"),
                         (F.col("rank") / F.col("deg")).alias("s")))
        inflow = (salted_join(links, share, ["from_node"], ["to_node"])
                  .groupBy(F.col("to_node").alias("name")).agg(F.sum("s").alias("inflow")))
        loose = ranks.filter("deg is null").agg(
            F.coalesce(F.sum("rank"), F.lit(0.0)).alias("m")).scalar()
        new = F.lit((1 - damping) / n) + F.lit(damping) * (
            F.coalesce("inflow", F.lit(0.0)) + loose / F.lit(float(n)))
        nxt = cut_lineage(ranks.join(inflow, "name", "left")
                          .select("name", "deg", new.alias("rank"),
                                  F.abs(new - F.col("rank")).alias("moved")))
        if kept is not None:
            discard(kept)
        kept, ranks = nxt, nxt.drop("moved")
        if tol > 0 and nxt.agg(F.sum("moved")).first()[0] < tol:
            break
    return ranks.select("name", F.col("rank").alias("centrality"))


def _levels(edges: DataFrame, roots: DataFrame, order: int | None) -> list[DataFrame]:
    """Shortest-path parents ``(root, node, parent)``, one table per distance.

    A link knows whether its end leads on, so that only such nodes are looked up
    for the next level, each once per root (``first``). All levels but that of
    the last ``order`` are written.
    """
    pairs = cut_lineage(edges.select("from_node", "to_node").distinct().filter("from_node <> to_node"))
    heads = pairs.select(F.col("from_node").alias("to_node")).distinct().withColumn("on", F.lit(True))
    links = cut_lineage(salted_join(pairs, heads, ["to_node"], ["from_node"], how="left").fillna(False, ["on"]))
    discard(pairs)
    n_links = links.count()
    start = roots.select(F.col("root").alias("from_node")).distinct()
    level = salted_join(links, start, ["from_node"], ["to_node"], how="left_semi").select(
        F.col("from_node").alias("root"), F.col("to_node").alias("node"), F.col("from_node").alias("parent"),
        "on", F.lit(True).alias("first"))
    parents = W.partitionBy("root", "node").orderBy("parent")
    visited, levels = None, []
    while order is None or len(levels) < order:
        last = order is not None and len(levels) == order - 1
        if not last:
            level = cut_lineage(level.withColumn("first", F.row_number().over(parents) == 1) if levels else level)
            if level.isEmpty():
                break
        levels.append(level.select("root", "node", "parent"))
        if last:
            break
        seen = level.filter("first").select("root", "node")
        visited = seen if visited is None else visited.unionByName(seen)
        step = level.filter("first and on").select("root", F.col("node").alias("from_node"))
        # the larger side is spread, the smaller one repeated
        if step.count() > n_links:
            found = salted_join(step, links, ["from_node"], ["root"])
        else:
            found = salted_join(links, step, ["from_node"], ["to_node"])
        found = found.filter("to_node <> root").select(
            "root", F.col("to_node").alias("node"), F.col("from_node").alias("parent"), "on")
        level = found.join(visited, ["root", "node"], "left_anti")
    return levels


def _grown(edges: DataFrame, roots: DataFrame, order: int | None, carry: list[str] = (),
           best: Column | None = None) -> list[DataFrame]:
    """All shortest paths, one table per distance: ``root, node, path`` up to the parent, ``steps``, ``on``, ``kept``.

    Paths take the columns ``carry`` of their links along (``steps``), so that they are never taken apart
    and put together again; new ones travel once, by root and node, to meet the pairs reached before.
    All levels but that of the last ``order`` are written. ``kept`` is the number of paths of the pair whose
    score ``best`` is the largest, 0 for the others; the links from the root are all kept.
    """
    step = F.array(F.struct(*carry)) if carry else F.lit(None).cast("boolean")
    pairs = cut_lineage(edges.filter("from_node <> to_node").select("from_node", "to_node", step.alias("own")).distinct())
    heads = pairs.select(F.col("from_node").alias("to_node")).distinct().withColumn("on", F.lit(True))
    links = cut_lineage(salted_join(pairs, heads, ["to_node"], ["from_node"], how="left").fillna(False, ["on"]))
    discard(pairs)
    n_links = links.count()
    start = roots.select(F.col("root").alias("from_node")).distinct()
    level = salted_join(links, start, ["from_node"], ["to_node"], how="left_semi").select(
        F.col("from_node").alias("root"), F.col("to_node").alias("node"), F.array("from_node").alias("path"),
        F.col("own").alias("steps"), "on", F.lit(1).alias("kept"))
    pair = W.partitionBy("root", "node")
    visited, levels = None, []
    while order is None or len(levels) < order:
        if levels and best is not None:
            top = F.col("score") == F.max("score").over(pair)
            level = level.withColumn("score", best).withColumn("top", F.coalesce(top.cast("int"), F.lit(0)))
            level = level.withColumn("kept", F.col("top") * F.sum("top").over(pair)).drop("score", "top")
        last = order is not None and len(levels) == order - 1
        if not last:
            level = cut_lineage(level)
            if level.isEmpty():
                break
        levels.append(level)
        if last:
            break
        seen = level.select("root", "node")
        visited = seen if visited is None else visited.unionByName(seen)
        front = level.filter("on").select("root", F.col("node").alias("from_node"), "path", "steps")
        # the larger side is spread, the smaller one repeated
        if front.count() > n_links:
            found = salted_join(front, links, ["from_node"], ["root"])
        else:
            found = salted_join(links, front, ["from_node"], ["to_node"])
        found = found.filter("to_node <> root").select(
            "root", F.col("to_node").alias("node"), F.array_append("path", F.col("from_node")).alias("path"),
            (F.concat("steps", "own") if carry else F.col("own")).alias("steps"), "on", F.lit(1).alias("kept"))
        level = found.join(visited, ["root", "node"], "left_anti")
    return levels


def _shown_paths(levels: list[DataFrame], *more: str | Column) -> DataFrame:
    """``(root, end_node, order, path)`` of grown levels, and ``more`` of their columns."""
    out = None
    for k, lv in enumerate(levels):
        part = lv.select("root", F.col("node").alias("end_node"), F.lit(k + 1).alias("order"),
                         F.array_append("path", F.col("node")).alias("path"), *more)
        out = part if out is None else out.unionByName(part)
    return out


def _one_per_pair(edges: DataFrame) -> bool:
    """Whether no two edges have the same ends."""
    return edges.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def shortest_paths(edges: DataFrame, roots: DataFrame, features: DataFrame | None = None,
                   order: int | None = 3) -> DataFrame:
    """All unweighted outgoing shortest paths ``(root, end_node, order, path)``.

    Breadth-first levels for every root together; all parents one level up are
    kept, so equally short paths are all found. With ``features``, levels are
    trimmed backwards to nodes that lead to a requested end before paths are
    written out. ``order=None`` follows the graph to its end.
    """
    if features is None and order is not None and order > 0:      # without a limit each pair is looked up once
        levels = _grown(edges, roots, order)
        if levels:
            return _shown_paths(levels)
    levels = _levels(edges, roots, order) if features is not None or order is None else []
    if features is not None:
        wanted = features.select(F.col("feature").alias("node")).distinct()
        later = None
        for k in range(len(levels) - 1, -1, -1):
            lv = levels[k]
            if later is None:
                levels[k] = cut_lineage(lv.join(wanted, "node", "left_semi"))
            else:
                ends = lv.join(wanted, "node", "left_semi").select("root", "node")
                levels[k] = cut_lineage(lv.join(ends.unionByName(later).distinct(), ["root", "node"], "left_semi"))
            later = levels[k].select("root", F.col("parent").alias("node")).distinct()
    out, grown = None, None
    for k, lv in enumerate(levels):
        if k < 2:           # the first parent is the root itself
            steps = ["root", "node"] if k == 0 else ["root", "parent", "node"]
            grown = lv.select("root", "node", F.array(*steps).alias("path"))
        else:
            prev = grown.select("root", F.col("node").alias("parent"), "path")
            grown = (lv.join(prev, ["root", "parent"])
                     .select("root", "node", F.array_append("path", F.col("node")).alias("path")))
        part = grown.select("root", F.col("node").alias("end_node"),
                            F.lit(k + 1).alias("order"), "path")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return roots.select("root", F.col("root").alias("end_node"), F.lit(0).alias("order"),
                            F.array("root").alias("path")).limit(0)
    if features is not None:
        out = out.join(wanted.withColumnRenamed("node", "end_node"), "end_node", "left_semi")
    return out.select("root", "end_node", "order", "path")


def path_edges(paths: DataFrame, carry: list[str] = ()) -> DataFrame:
    """One row per step: ``root, end_node, order, path, pos, from_node, to_node``."""
    head = ["root", "end_node", "order", "path", *carry]
    steps = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"),
                         F.slice("path", 2, F.size("path") - 1).alias("b"))
    return (paths.select(*head, F.posexplode(steps).alias("pos", "e"))
            .select(*head, "pos", F.col("e.a").alias("from_node"), F.col("e.b").alias("to_node")))


def score_paths(paths: DataFrame, edges: DataFrame, only: str | None = None) -> DataFrame:
    """Direction, mean estimate, regions and mean -log10(padj) of every path.

    ``only`` names the one mean that is wanted beside the direction; nothing else travels then.
    """
    cols = ["from_node", "to_node", "estimate", *(["regions"] if only is None else [])]
    has_p = "padj" in edges.columns and only in (None, "mean_log_padj")
    e = edges.select(*cols, *(["padj"] if has_p else []))
    aggs = [(F.product(F.signum("estimate")) + F.lit(0.0)).alias("dir"),
            F.avg("estimate").alias("mean_estimate")]
    if only is None:
        aggs.append(F.array_sort(F.collect_list(F.struct("pos", "regions"))).alias("r"))  # <= order items
    if has_p:
        strength = F.when(F.col("padj") > 0, -F.log10("padj")).when(
            F.col("padj") == 0, F.lit(float("inf")))
        # one missing value makes the mean missing
        aggs.append(F.when(F.count("padj") == F.count(F.lit(1)), F.avg(strength)).alias("mean_log_padj"))
    d = path_edges(paths).join(e, ["from_node", "to_node"])
    d = d.groupBy("root", "end_node", "order", "path").agg(*aggs)
    if only is not None:
        return d.withColumnRenamed("root", "start_node").select("start_node", "end_node", "order", "path", "dir", only)
    return (d.withColumn("path_regions", F.concat_ws(";", F.transform("r", lambda s: s["regions"])))
            .drop("r").withColumnRenamed("root", "start_node"))


def _step_values(column: str) -> Column:
    return F.filter(F.transform("steps", lambda s: s[column]), lambda x: x.isNotNull())


def _step_scores(has_p: bool) -> dict[str, Column]:
    """Direction and means of the carried ``steps`` of a path, as :func:`score_paths` has them."""
    def mean(x):
        return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))
    e = _step_values("estimate")
    out = {"dir": F.when(F.size(e) > 0, F.aggregate(e, F.lit(1.0), lambda a, v: a * F.signum(v)) + F.lit(0.0)),
           "mean_estimate": mean(e)}
    if has_p:
        strength = F.transform(_step_values("padj"), lambda p: F.when(p > 0, -F.log10(p)).when(p == 0, F.lit(float("inf"))))
        whole = F.size(_step_values("padj")) == F.size("steps")      # one missing value makes the mean missing
        out["mean_log_padj"] = F.when(whole, mean(F.filter(strength, lambda x: x.isNotNull())))
    return out


def scored_paths(edges: DataFrame, roots: DataFrame, order: int | None = 3, by: str | None = None) -> DataFrame:
    """:func:`score_paths` of all shortest paths, in one go: scores are taken along while the paths grow.

    ``by`` keeps the direct edges and the best paths to each end node only, as :func:`prune_paths` does.
    """
    if not _one_per_pair(edges):
        scored = score_paths(shortest_paths(edges, roots, None, order), edges)
        return scored if by is None else prune_paths(cut_lineage(scored), order, by=by)
    has_p = "padj" in edges.columns
    scores = _step_scores(has_p)
    levels = _grown(edges, roots, order, ["estimate", "regions", *(["padj"] if has_p else [])],
                    None if by is None else F.round(scores[by], 12))
    if not levels:
        return score_paths(shortest_paths(edges, roots, None, order), edges)
    out = _shown_paths([lv.filter("kept > 0") for lv in levels], *[c.alias(n) for n, c in scores.items()],
                       F.concat_ws(";", F.transform("steps", lambda s: s["regions"])).alias("path_regions"))
    return out.withColumnRenamed("root", "start_node")


def path_text(scored: DataFrame) -> DataFrame:
    """Show paths as ``a;b;c``."""
    return scored.withColumn("path", F.concat_ws(";", F.transform(
        "path", lambda x: x.cast("string"))))


def prune_paths(scored: DataFrame, order: int | None = 3, keep_all: bool = False,
                by: str = "mean_estimate") -> DataFrame:
    """Direct edges plus the best path to each end node."""
    d = scored if order is None else scored.filter(F.col("order") <= order)
    if keep_all:
        return d
    keys = ["start_node", "end_node"]
    # Equal means may differ in the last bits with the order of summation.
    score = F.round(by, 12)
    best = d.groupBy(*keys).agg(F.max(score).alias("_best"))
    return (salted_join(d, best, keys, ["path"])
            .filter((F.col("order") == 1) | (score == F.col("_best"))).drop("_best"))


def tf_network(edges: DataFrame, roots: DataFrame, features: DataFrame | None = None,
               order: int | None = 3, keep_all: bool = False, by: str = "mean_estimate",
               min_paths: int = 3) -> DataFrame:
    """Edges of the pruned subnetwork around each root.

    Adds ``root``, ``end_node`` (the target the edge leads to) and ``comb_dir``
    (sign of the whole path). Roots with fewer than ``min_paths`` paths are left
    out; for a single root that is an error.
    """
    if features is None and _one_per_pair(edges):
        return _grown_network(edges, roots, order, keep_all, by, min_paths)
    paths = shortest_paths(edges, roots, features, order)
    scored = cut_lineage(score_paths(paths, edges, by))
    enough = (scored.groupBy("start_node").agg(F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") >= min_paths).select("start_node"))
    single = roots.limit(2).count() == 1
    if single and enough.isEmpty():
        raise ValueError("the selected TF has too few targets")
    scored = salted_join(scored, enough, ["start_node"], ["path"], how="left_semi")
    kept = prune_paths(scored, order, keep_all, by)
    used = (path_edges(kept.withColumnsRenamed({"start_node": "root", "dir": "comb_dir"}),
                       ["comb_dir"])
            .select("root", "end_node", "comb_dir", "from_node", "to_node").distinct())
    return used.join(edges, ["from_node", "to_node"])


def _grown_network(edges: DataFrame, roots: DataFrame, order: int | None, keep_all: bool, by: str,
                   min_paths: int) -> DataFrame:
    """:func:`tf_network` of all end nodes; edges of kept paths come from the paths themselves."""
    carry = ["estimate", *(["padj"] if by == "mean_log_padj" else [])]
    score = _step_scores(by == "mean_log_padj")
    levels = _grown(edges, roots, order, carry, None if keep_all else F.round(score[by], 12))
    single = roots.limit(2).count() == 1
    if single or min_paths > 1:
        levels = [lv if "_table_path" in lv.__dict__ else cut_lineage(lv) for lv in levels]
    if min_paths > 1 and levels:
        enough = (_shown_paths(levels).groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") >= min_paths).select("root"))
        levels = [salted_join(lv, enough, ["root"], ["node"], how="left_semi") for lv in levels]
    if single and all(lv.isEmpty() for lv in levels):
        raise ValueError("the selected TF has too few targets")
    used = None
    for k, lv in enumerate(levels):
        d = lv.filter("kept > 0").select(
            "root", F.col("node").alias("end_node"), score["dir"].alias("comb_dir"), "kept",
            F.explode(F.arrays_zip("path", F.array_append(F.slice("path", 2, k), F.col("node")).alias("to"), "steps"))
            .alias("e"))
        d = d.select("root", "end_node", "comb_dir", "kept", F.col("e.path").alias("from_node"), F.col("e.to").alias("to_node"),
                     *[F.col(f"e.steps.{c}").alias(c) for c in carry])
        if k:      # paths to one end may share edges; in the last level they lie together
            alone = d.filter("kept = 1").drop("kept") if k < len(levels) - 1 and not keep_all else None
            d = (d if alone is None else d.filter("kept > 1")).drop("kept").distinct()
            d = d if alone is None else d.unionByName(alone)
        else:
            d = d.drop("kept")
        used = d if used is None else used.unionByName(d)
    if used is None:
        return edges.limit(0).select(F.col("from_node").alias("root"), F.col("from_node").alias("end_node"),
                                     F.lit(0.0).alias("comb_dir"), *edges.columns)
    if set(edges.columns) == {"from_node", "to_node", *carry}:
        return used.select("from_node", "to_node", "root", "end_node", "comb_dir", *carry)
    return used.drop(*carry).join(edges, ["from_node", "to_node"])
