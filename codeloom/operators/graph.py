"""Walks over the edge table, one join per level.

Levels keep each node once, and only nodes that no earlier level holds, so all levels together never hold more rows than the graph has nodes. Every level is written: it is small where the walk is, the next one
joins its rows with the edges and nothing is walked twice.
"""

import functools

from pyspark.sql import DataFrame, functions as F

from codeloom import constants as C
from codeloom.operators.lineage import materialize

TYPE_KINDS = ("implements", "extends")


def _steps(edges: DataFrame, kinds, frontier: DataFrame, src="source_id", dst="target_id") -> DataFrame:
    """(from, to) pairs in walking direction that start at the frontier; pairs may repeat."""
    rows = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    rows = rows.where(F.col(dst).isNotNull()).select(F.col(src).alias("_from"), F.col(dst).alias("_to"))
    return rows.join(frontier, "_from").select("_from", "_to")


def _both_ways(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    return _steps(edges, None, frontier).unionByName(_steps(edges, None, frontier, "target_id", "source_id"))


def _bounded_walk(step, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, via, depth) of every node within ``depth`` steps, at its least depth; ``via`` is the least previous node there, ``step`` the pairs that start at a frontier.

    A node that was met before leads nowhere that its first level did not lead to.
    """
    frontier = _start(seeds)
    levels = []
    for d in range(1, depth + 1):
        met = step(frontier).groupBy(F.col("_to").alias("node")).agg(F.min("_from").alias("via"))
        if levels:
            met = met.join(functools.reduce(DataFrame.unionByName, levels).select("node"), "node", "left_anti")
        levels.append(materialize(met.select("node", "via", F.lit(d).alias("depth"))))
        frontier = levels[-1].select(F.col("node").alias("_from"))
    return functools.reduce(DataFrame.unionByName, levels)


def _start(seeds: DataFrame) -> DataFrame:
    """Distinct seeds, written: few, whatever the table they were found in."""
    return materialize(seeds.toDF("_from").where(F.col("_from").isNotNull()).distinct())


def upstream_callers(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """Callers of the seeds: (node, depth, via). A seed shows up only when it lies on a cycle."""
    depth = max(1, min(max_depth, C.CALL_DEPTH_MAX))
    return _bounded_walk(lambda f: _steps(edges, ["calls"], f, "target_id", "source_id"), seeds, depth).select("node", "depth", "via")


def downstream_callees(edges: DataFrame, seeds: DataFrame, max_depth: int = 1) -> DataFrame:
    """Symbols called from the seeds: (node, depth, via)."""
    depth = max(1, min(max_depth, C.CALL_DEPTH_MAX))
    return _bounded_walk(lambda f: _steps(edges, ["calls"], f), seeds, depth).select("node", "depth", "via")


def graph_proximity(edges: DataFrame, seeds: DataFrame, max_depth: int = C.PROXIMITY_DEPTH) -> DataFrame:
    """Hop distance from the nearest seed over edges of any kind in either direction."""
    start = _start(seeds).toDF("node")
    walk = _bounded_walk(lambda f: _both_ways(edges, f), start, max_depth).select("node", "depth").distinct()
    return (start.select("node", F.lit(0).alias("depth")).unionByName(walk)
            .groupBy("node").agg(F.min("depth").alias("depth")))


def proximity_of(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, max_depth: int = C.PROXIMITY_DEPTH) -> DataFrame:
    """The same distance for a few ``nodes`` only: (node, depth) of those within ``max_depth``.

    Both ends walk towards each other, the seeds the shorter part, and meet in the middle, so a distance of three needs one level around the seeds and two around the nodes.
    """
    out = max_depth // 2
    start = _start(seeds).toDF("node")
    asked = materialize(nodes.toDF("asked").where(F.col("asked").isNotNull()).distinct())
    levels = [start.select("node", F.lit(0).alias("depth"))]
    if out:
        levels.append(_bounded_walk(lambda f: _both_ways(edges, f), start, out).select("node", "depth"))
    near = functools.reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.min("depth").alias("depth"))
    back = [asked.select("asked", F.col("asked").alias("at"), F.lit(0).alias("back"))]
    for d in range(1, max_depth - out + 1):
        frontier = back[-1].select(F.col("at").alias("_from")).distinct()
        pairs = _both_ways(edges, frontier).join(back[-1].select("asked", F.col("at").alias("_from")), "_from")
        back.append(materialize(pairs.select("asked", F.col("_to").alias("at"), F.lit(d).alias("back")).distinct()))
    met = functools.reduce(DataFrame.unionByName, back).join(near, F.col("at") == F.col("node"))
    found = met.groupBy(F.col("asked").alias("node")).agg(F.min(F.col("depth") + F.col("back")).alias("depth"))
    return found.where(F.col("depth") <= max_depth)


def subtypes(edges: DataFrame, seeds: DataFrame, transitive: bool = True) -> DataFrame:
    """(node, depth) of implementing and extending symbols: each symbol once per length of a path to it, symbols on or below a
    cycle, which have paths of any length, with the shortest only.

    What is reached is walked with a visited set. If no symbol is met again at a later level, that is the result. Otherwise edges from symbols that nothing points to are taken away, again and
    again: the targets of what is left are on or below a cycle. The others form no cycle, and are walked level by level. Each of the walks ends after
    at most as many rounds as there are symbols.
    """
    def down(frontier):
        return _steps(edges, TYPE_KINDS, frontier, "target_id", "source_id")
    start = _start(seeds)
    if not transitive:
        return down(start).select(F.col("_to").alias("node"), F.lit(1).alias("depth")).distinct()
    found, inside, frontier, met_again = [], [], start, False
    while True:
        pairs = materialize(down(frontier).distinct())
        level = pairs.select(F.col("_to").alias("node")).distinct()
        known = functools.reduce(DataFrame.unionByName, [f.select("node") for f in found]).withColumn("again", F.lit(True)) if found else None
        level = level.withColumn("again", F.lit(None).cast("boolean")) if known is None else level.join(known, "node", "left")
        level = materialize(level.select("node", "again", F.lit(len(found) + 1).alias("depth")))
        tally = level.agg(F.count("again").alias("again"), F.count("*").alias("all")).first()
        met_again |= tally["again"] > 0
        inside.append(pairs)
        if tally["again"] == tally["all"]:
            break
        found.append(level.where(F.col("again").isNull()).select("node", "depth"))
        frontier = found[-1].select(F.col("node").alias("_from"))
    if not found:
        return level.select("node", "depth")
    reached = functools.reduce(DataFrame.unionByName, found)
    # a seed that is reached is met again too
    if not met_again and reached.join(start, reached["node"] == start["_from"], "left_semi").isEmpty():
        return reached

    def levels(pairs):
        out, front, depth = [], start, 0
        while True:
            depth += 1
            level = materialize(pairs.join(front, "_from").select(F.col("_to").alias("node")).distinct().withColumn("depth", F.lit(depth)))
            if level.isEmpty():
                return functools.reduce(DataFrame.unionByName, out) if out else level
            out.append(level)
            front = level.select(F.col("node").alias("_from"))

    inside = materialize(functools.reduce(DataFrame.unionByName, inside).distinct())
    left, size = inside, inside.count()
    while size:
        left = materialize(left.join(left.select(F.col("_to").alias("_from")).distinct(), "_from", "left_semi"))
        before, size = size, left.count()
        if size == before:
            break
    if not size:
        return levels(inside)
    cyclic = left.select(F.col("_to").alias("node")).distinct()
    free = materialize(inside.join(cyclic, inside["_to"] == cyclic["node"], "left_anti"))
    return levels(free).unionByName(reached.join(cyclic, "node", "left_semi"))


def describe_nodes(walk: DataFrame, symbols: DataFrame, *extra: str) -> DataFrame:
    """Walk results with the symbol columns the reports show."""
    return walk.join(symbols.withColumnRenamed("sym_id", "node"), "node").select(
        "node", "symbol_key", "name", "qualified_name", "kind", "signature", "docstring",
        "path", "start_line", "end_line", "depth", *extra)
