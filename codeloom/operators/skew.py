"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 0.001   # a hot key holds more than this share of the rows: fewer than 1000 of them
SALTS = 64
FEW = 100_000       # a right side of at most so many rows is sent to every task instead: then no row of the left side moves


def hot_keys(df: DataFrame, key: str, floor: int, counts: DataFrame | None = None) -> DataFrame:
    """Keys with more than ``HOT_SHARE`` of all rows and more than ``floor`` rows; ``counts`` (key, ``_n``) saves the pass."""
    if counts is None:
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return (counts.where((F.col("_n") > floor) & (F.col("_n") > total * HOT_SHARE))
            .select(F.col(key).alias("_hot")))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, floor: int = 1_000_000, counts: DataFrame | None = None,
                     few: int = FEW) -> DataFrame:
    """Left join on ``key`` against a written right side with one row per key. One of at most ``few`` rows is broadcast.

    One counting pass over the key column looks for hot keys; without any only null keys are spread.
    Rows of a hot key spread over ``SALTS`` partitions and their one right-hand row is repeated
    for each salt; rows with a null key, which match nothing, spread as well; all other keys keep salt 0.
    """
    if right.limit(few + 1).count() <= few:
        return left.join(F.broadcast(right), key, "left")
    hot = hot_keys(left, key, floor, counts)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
    if hot.isEmpty():
        lhs = left.withColumn("_salt", F.when(F.col(key).isNull(), salt).otherwise(0).cast("int"))
        return lhs.join(right.withColumn("_salt", F.lit(0)), [key, "_salt"], "left").drop("_salt")
    hot = F.broadcast(hot)   # at most 1 / HOT_SHARE rows
    spread = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), salt).otherwise(0).cast("int")
    lhs = (left.join(hot, F.col(key) == F.col("_hot"), "left")
           .withColumn("_salt", spread).drop("_hot"))
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0)))
    rhs = (right.join(hot, F.col(key) == F.col("_hot"), "left")
           .withColumn("_salt", F.explode(salts)).drop("_hot"))
    return lhs.join(rhs, [key, "_salt"], "left").drop("_salt")
