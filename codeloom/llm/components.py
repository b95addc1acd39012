"""Distributed connected components."""

from pyspark.sql import DataFrame, functions as F

from codeloom.llm.storage import materialize


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Each node that has an edge to another node, as ``node``, and the smallest node it reaches, as ``component``.

    Alternates the large-star and the small-star step: nodes first hang their larger neighbours on their smallest
    neighbour, then themselves and their smaller neighbours. Every step keeps the components and no step makes more
    edges than it got, so a node with very many neighbours is no special case; minima are combined before each shuffle
    and the joins are of written tables, so adaptive execution can split a skewed partition. Each round is
    a table in the shared folder. It ends when every node hangs on one node that hangs on none. Loops and edges
    with a null end are left out. Nodes may be of any ordered type.
    """
    pair = edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u"))
    stars = materialize(pair.where(edges[left].isNotNull() & edges[right].isNotNull()).where("u <> v").distinct())
    while not _flat(stars):
        both = stars.union(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))   # v: the node, u: its neighbour
        low = materialize(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = materialize(large)
        low = materialize(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        stars = materialize(small.union(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct())
    roots = stars.select(F.col("u").alias("node")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))


def _flat(stars: DataFrame) -> bool:
    hanging = stars.select(F.col("v").alias("u")).distinct()
    return stars.groupBy("v").count().where("count > 1").isEmpty() and stars.join(hanging, "u", "left_semi").isEmpty()
