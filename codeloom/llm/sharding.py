"""Shards of nearly equal bytes: a minimax cut of an ordered row of atomic groups."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.storage import materialize

BLOCKS = 8192   # runs of groups that the driver looks at together, about


def running(key: str, size: str):
    """Adds to sorted partitions: ``part``, ``place`` (rows of the part before) and ``before`` (their sizes)."""
    def run(batches):
        part, place, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(size).to_numpy()
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(np.arange(place, place + len(sizes))),
                 pa.array(total + ends - sizes)], [*batch.schema.names, "part", "place", "before"])
            place += len(sizes)
            total += int(ends[-1]) if len(ends) else 0
    return run


def laid_out(df: DataFrame, keys: list[str], size: str) -> tuple[DataFrame, DataFrame]:
    """``df`` as a written table in the global order of ``keys`` with ``running``'s columns, and per part what comes before it: ``rows_before`` and
    ``size_before``. Only one row per part comes to the driver."""
    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + ", part int, place bigint, before bigint"
    table = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(running(keys[0], size), schema))
    parts = sorted(tuple(r) for r in table.groupBy("part").agg(F.count("*"), F.sum(size)).collect())
    rows = total = 0
    out = []
    for part, n, s in parts:
        out.append((part, rows, total))
        rows, total = rows + n, total + s
    return table, df.sparkSession.createDataFrame(out, "part int, rows_before bigint, size_before bigint")


class Blocks:
    """Runs of neighbouring groups that cover all sizes: bounds, and whether a run is a single group. Inside a run of several the bounds of
    groups aren't known."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.starts, self.ends = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.single = np.array([r[2] == 1 for r in rows])
        self.total = int(self.ends[-1])

    def cut(self, place: int, hopeful: bool) -> int:
        """The last bound of groups up to ``place``: at the start of the run it falls in, or (``hopeful``) maybe at the place itself."""
        i = int(np.searchsorted(self.ends, place, "right"))
        return place if hopeful and not self.single[i] else int(self.starts[i])

    def cuts(self, shards: int, capacity: int, hopeful: bool) -> list[int] | None:
        """Fills shards in turn as far as ``capacity`` allows; None if there is more than ``shards`` hold."""
        at, found = 0, []
        for _ in range(shards):
            if at + capacity >= self.total:
                return found
            bound = self.cut(at + capacity, hopeful)
            if bound <= at:
                return None
            at = bound
            found.append(at)
        return None

    def smallest(self, shards: int, low: int, high: int, hopeful: bool) -> int:
        """The smallest capacity that suffices, by bisection; ``high`` does."""
        while low < high:
            middle = (low + high) // 2
            if self.cuts(shards, middle, hopeful) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def near_cuts(self, shards: int, low: int, high: int) -> list[int]:
        """Runs in which a cut may fall, for any capacity from ``low`` to ``high``."""
        near = far = 0
        found: set[int] = set()
        while len(found) <= len(self.ends) and near + low < self.total and shards:
            first = int(np.searchsorted(self.ends, near + low, "right"))
            last = int(np.searchsorted(self.ends, min(far + high, self.total - 1), "right"))
            found.update(range(first, last + 1))
            near, far = max(int(self.starts[first]), near), self.cut(min(far + high, self.total - 1), True)
            shards -= 1
        return sorted(found)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that ``shards`` contiguous runs of the ordered groups (``start``, ``size``) can keep, and the starts of the runs
    after the first.

    The driver sees about ``BLOCKS`` runs of groups at a time. It brackets the capacity by two bisections, one that knows
    no bound inside a run and one that takes any place there for a bound, then asks for finer runs near the possible cuts, until those
    are single groups and both agree. Each round reads the groups once and narrows these places about tenfold.
    """
    row = groups.agg(F.sum("size"), F.max("size")).first()
    high, low = int(row[0] or 0), int(row[1] or 0)
    zones, width = [(0, high)], high
    while high:
        width = max(1, min(width // 2, -(-sum(b - a for a, b in zones) // BLOCKS)))   # finer each time
        zone, inside = F.lit(0), F.lit(False)
        for a, b in zones:
            zone += (F.col("start") >= a).cast("int") + (F.col("start") >= b).cast("int")
            inside |= (F.col("start") >= a) & (F.col("start") < b)
        # a group larger than a cell is a run of its own: it is the last one that starts in its cell
        cell = F.when(inside, F.floor(F.col("start") / width) * 2 + (F.col("size") > width).cast("int")).otherwise(-1)
        runs = groups.groupBy(zone.alias("zone"), cell.alias("cell")).agg(
            F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b"), F.count("*").alias("n"))
        blocks = Blocks([tuple(r) for r in runs.select("a", "b", "n").collect()])
        low = blocks.smallest(shards, low, high, True)
        high = blocks.smallest(shards, low, high, False)
        near = blocks.near_cuts(shards, low, high)
        if blocks.single[near].all():
            return high, blocks.cuts(shards, high, False)
        zones = []
        for i in near:
            a, b = int(blocks.starts[i]), int(blocks.ends[i])
            if zones and zones[-1][1] == a:
                zones[-1] = zones[-1][0], b
            else:
                zones.append((a, b))
    return 0, []


def shard_documents(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id`` under its own name, ``size``, ``text_crc32``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 without gaps in
    its shard).

    Size is the bytes of the text and 1. Equal texts are one atomic group; null counts as the empty text. Groups are ordered by their texts' digest, and the shards
    are contiguous runs of them of the smallest possible largest size (``minimax_cuts``). A group larger than an even share has a shard as large as
    itself at least. Sizes of a group are added up before they are moved; rows are ordered by (digest, id), so a group with very many copies is
    spread over tasks. Repeated rows are kept, null ids come last in their group; other columns are ignored. Texts of any length are whole; an empty table gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select(F.col(id).cast("bigint").alias("id"), (F.octet_length(content) + 1).cast("bigint").alias("size"),
                                   F.crc32(content).alias("text_crc32"), F.sha2(content, 256).alias("digest")))
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("size")))
    table, bases = laid_out(groups, ["digest"], "size")
    spark = docs.sparkSession
    ordered = table.join(F.broadcast(bases), "part").select("digest", "size", (F.col("before") + F.col("size_before")).alias("start"))
    ordered = materialize(ordered)
    _, cuts = minimax_cuts(ordered, shards)
    firsts = sorted(r[0] for r in ordered.where(F.col("start").isin(cuts)).select("digest").collect()) if cuts else []
    shard = F.lit(0)
    for digest in firsts:
        shard = shard + (F.col("digest") >= digest).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("spread", F.coalesce("id", F.lit((1 << 63) - 1)))
    table, bases = laid_out(rows, ["digest", "spread", "text_crc32"], "size")
    counts = dict(tuple(r) for r in rows.groupBy("shard").count().collect())
    first, before = F.lit(0).cast("bigint"), 0
    for i in range(shards):
        first = F.when(F.col("shard") == i, F.lit(before).cast("bigint")).otherwise(first)
        before += counts.get(i, 0)
    out = table.join(F.broadcast(bases), "part")
    return out.select(F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("place") + F.col("rows_before") - first).alias("slot"))
