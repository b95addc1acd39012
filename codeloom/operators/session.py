"""Turn-aware deduplication of emitted code spans, as a batch over a request log.

Input rows: session_id, turn, seq, key, force. A request is answered by a back reference when
its key was emitted in an earlier turn and it is not forced. A request that is not forced emits
only in the first turn of its key or beside another emission of its own turn, so:

  last emission before a row = the key's first turn, or its latest forced turn if later
  deduplicated = not forced, and that emission lies in an earlier turn

Rows are reduced to one per (session, key, turn) before any window runs, and the windows cut
turns into blocks, so a session that holds most of the log does not land in one task.
"""

from pyspark.sql import DataFrame, Window, functions as F

TURN_BLOCK = 1024


def _latest_forced_before(turns: DataFrame) -> DataFrame:
    """Latest forced turn before each turn of a (session, key): a blockwise running maximum."""
    forced = F.when(F.col("forced_seq").isNotNull(), F.col("turn"))
    blocked = turns.withColumn("_block", F.floor(F.col("turn") / TURN_BLOCK))
    inside = Window.partitionBy("session_id", "key", "_block").orderBy("turn").rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy("session_id", "key").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    per_block = (blocked.groupBy("session_id", "key", "_block").agg(F.max(forced).alias("_top"))
                 .withColumn("_carry", F.max("_top").over(across)).drop("_top"))
    return (blocked.withColumn("_inside", F.max(forced).over(inside))
            .join(per_block, ["session_id", "key", "_block"])
            .withColumn("forced_before", F.coalesce("_inside", "_carry"))
            .drop("_block", "_inside", "_carry"))


def deduplicate(requests: DataFrame) -> DataFrame:
    """Requests with ``is_deduplicated`` and, where true, the ``source_turn`` referred to."""
    turns = requests.groupBy("session_id", "key", "turn").agg(
        F.min(F.when(F.col("force"), F.col("seq"))).alias("forced_seq"))
    first = turns.groupBy("session_id", "key").agg(F.min("turn").alias("first_turn"))
    turns = _latest_forced_before(turns).join(first, ["session_id", "key"])
    known = requests.join(turns, ["session_id", "key", "turn"])
    forced_now = F.coalesce(F.col("forced_seq") < F.col("seq"), F.lit(False))
    earlier = F.when(F.col("first_turn") < F.col("turn"),
                     F.greatest(F.col("first_turn"), F.coalesce("forced_before", "first_turn")))
    deduplicated = ~F.col("force") & ~forced_now & earlier.isNotNull()
    return known.select(*requests.columns, deduplicated.alias("is_deduplicated"),
                        F.when(deduplicated, earlier).alias("source_turn"))
