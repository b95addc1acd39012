"""Innermost enclosing span of points inside files, as one ordered sweep per file.

Spans of a file nest. Opening a span raises the depth and closing lowers it, so the span
around a point at depth k is the latest one that opened at depth k. No pairs are formed.
"""

from pyspark.sql import DataFrame, Window, functions as F

CLOSE, BEFORE_OPEN, OPEN, POINT = 0, 1, 2, 3


def enclosing(points: DataFrame, spans: DataFrame, out: str, payload, at: str = "start_byte",
              outside_own: bool = False) -> DataFrame:
    """Points with ``out``: the payload of the innermost span [start_byte, end_byte) around ``at``.

    With ``outside_own`` a span starting exactly at the point does not count.
    """
    payload_type = spans.select(payload.alias("p")).schema["p"].dataType
    nothing = F.lit(None).cast(payload_type)
    kept = F.struct(*(F.col(c) for c in points.columns))
    row_type = points.select(kept.alias("r")).schema["r"].dataType
    asks = points.select("path", F.col(at).alias("_at"), F.lit(BEFORE_OPEN if outside_own else POINT).alias("_code"),
                         F.lit(0).alias("_end"), F.lit(0).alias("_step"), nothing.alias("_payload"), kept.alias("_row"))
    no_row = F.lit(None).cast(row_type)
    opens = spans.select("path", F.col("start_byte").alias("_at"), F.lit(OPEN).alias("_code"), (-F.col("end_byte")).alias("_end"),
                         F.lit(1).alias("_step"), payload.alias("_payload"), no_row.alias("_row"))
    closes = spans.select("path", F.col("end_byte").alias("_at"), F.lit(CLOSE).alias("_code"), F.lit(0).alias("_end"),
                          F.lit(-1).alias("_step"), nothing.alias("_payload"), no_row.alias("_row"))
    order = ("_at", "_code", "_end")
    sweep = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    events = asks.unionByName(opens).unionByName(closes).withColumn("_depth", F.sum("_step").over(sweep))
    level = Window.partitionBy("path", "_depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("_depth") > 0, F.last(F.when(F.col("_code") == OPEN, F.col("_payload")), ignorenulls=True).over(level))
    return events.withColumn("_found", found).where(F.col("_row").isNotNull()).select("_row.*", F.col("_found").alias(out))
