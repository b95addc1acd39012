"""Places of rows in a global order, without one task that sees them all."""

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.storage import free_prefix, materialize


def in_order(rows: DataFrame, order: list[Column], part: str, row: str) -> DataFrame:
    """``rows`` range-sorted by ``order`` and written: ``part`` rises with the order, and ``row`` counts from 0 within it.

    Rows that are equal in ``order`` share a part. The table is written once, so the numbers don't change when an executor is lost.
    """
    # Spark's increasing ids are the task's number above 33 bits of a running number
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    return materialize(placed.withColumn(part, F.shiftright(row, 33).cast("int")).withColumn(row, F.col(row).bitwiseAND(F.lit((1 << 33) - 1))))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their place in the order, from 1, as ``rank``. The driver gets one count per part of the sort."""
    prefix = free_prefix([*rows.columns, rank])
    part, row = prefix + "part", prefix + "row"
    placed = in_order(rows, order, part, row)
    before, pairs = 0, [F.lit(-1), F.lit(0)]
    for key, count in sorted(placed.groupBy(part).count().collect()):
        pairs += [F.lit(key), F.lit(before)]
        before += count
    return placed.withColumn(rank, (F.create_map(*pairs)[F.col(part)] + F.col(row) + 1).cast("bigint")).drop(part, row)
