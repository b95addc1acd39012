"""Best-fit packing of documents into sequences in bulk-synchronous rounds."""

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.ranks import in_order
from codeloom.llm.storage import free_prefix, materialize
from codeloom.llm.tokens import encoder_of

BAND = 4          # a round takes documents of a length down to that part of its longest
PART = 512        # pieces that leave a task together
CHUNK = 1 << 20   # new sequences that one row of the driver stands for
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
TAKES = "size int, first bigint, last bigint, room int, gap bigint, each int, used int"
GAPS = "room int, first bigint, last bigint, left int"


def cutter(content, longest: int, end_id: int):
    def run(batches):
        encoder = encoder_of(content)
        for batch in batches:
            names = batch.column(0)
            for first, flat, ends in encoder.encode(batch.column(1)):
                lengths = np.diff(ends) + 1
                ids = np.full(int(lengths.sum()), end_id, "<u4")
                inside = np.ones(len(ids), bool)
                inside[np.cumsum(lengths) - 1] = False
                ids[inside] = flat
                pieces = -(-lengths // longest)
                head = lengths - (pieces - 1) * longest   # the first piece is the one that may be shorter
                at = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(piece == 0, head[at], longest)
                start = np.where(piece == 0, 0, head[at] + (piece - 1) * longest)
                bounds = np.concatenate([[0], np.cumsum(length)])
                for a in range(0, len(at), PART):
                    b = min(a + PART, len(at))
                    cuts = pa.py_buffer(((bounds[a: b + 1] - bounds[a]) * 4).astype(np.int32))
                    data = pa.Array.from_buffers(pa.binary(), b - a, [None, cuts, pa.py_buffer(ids[bounds[a]: bounds[b]])])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(first + at[a:b])), pa.array(piece[a:b].astype(np.int32)), pa.array(start[a:b]), pa.array(length[a:b]), data],
                                                     ["doc_id", "piece", "start", "length", "ids"])
    return run


def token_pieces(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``piece`` (from 0), ``start`` (ids before it), ``length``, ``ids`` (little-endian unsigned 32-bit).

    A document is its token ids and ``end_id``. One of at most ``longest`` ids is one piece; longer ones are cut into pieces of ``longest``, of which the first may be
    shorter. Null is the empty text, which is its end id alone. Null ids stay null; repeated rows are documents of their own; other columns are ignored. Very long texts
    are encoded whole.
    """
    content = docs.sparkSession.sparkContext.broadcast(tokenizer)
    return docs.select(F.col(id).cast("bigint"), text).mapInArrow(cutter(content, longest, end_id), PIECES)


def sweep(items: dict[int, int], gaps: dict[int, int], longest: int) -> tuple[list[tuple], list[tuple], int]:
    """One round over numbers of items and gaps of each size: every item, longest first, goes to the smallest gap that holds it (its successor among the gaps),
    and to a new sequence if there is none.

    Items of one size, and gaps of one size, are told apart by their rank only, so a conflict is settled by rank and a step takes a whole run of ranks.
    Returns the steps ``(size, first, last, room, gap, each, used)``: items of ``size`` with ranks from ``first`` to before ``last`` go, ``each`` to a gap, to gaps of ``room``
    from rank ``gap`` on, of which ``used`` is taken in this round already; the runs ``(room, first, last, left)`` of gaps that were changed; and the number of new sequences, whose
    ``room`` is 0 and whose ranks follow each other.
    """
    runs: dict[int, list[tuple]] = {room: [(room, 0, n, 0)] for room, n in gaps.items() if n}   # by what is left: (room, first, last, used)
    rooms = sorted(runs)
    steps, fresh = [], 0

    def put(left: int, run: tuple) -> None:
        if run[1] < run[2]:
            if left not in runs:
                insort(rooms, left)
            runs.setdefault(left, []).append(run)

    for size in sorted(items, reverse=True):
        done, n = 0, items[size]
        while done < n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                left = rooms[at]
                room, first, last, used = runs[left].pop()
                if not runs[left]:
                    del runs[left], rooms[at]
            else:
                left = longest
                room, first, last, used = 0, fresh, fresh + -(-(n - done) // (longest // size)), 0
                fresh = last
            each = left // size
            full = min(last - first, (n - done) // each)
            if full:
                steps.append((size, done, done + full * each, room, first, each, used))
                put(left - each * size, (room, first, first + full, used + each * size))
                done, first = done + full * each, first + full
            if first < last and done < n:   # fewer than a gap holds
                rest = n - done
                steps.append((size, done, n, room, first, each, used))
                put(left - rest * size, (room, first, first + 1, used + rest * size))
                done, first = n, first + 1
            put(left, (room, first, last, used))
    changed = [(room, first, last, left) for left, same in runs.items() for room, first, last, used in same if used]
    return steps, changed, fresh


def ranked_by_size(rows: DataFrame, size: str, others: list[str], rank: str) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` range-sorted by ``size``, each with its rank (from 0) among those of its size, and the number of rows of each size.

    The driver gets one row per size and part of the sort, of which there are at most as many as sizes and parts together. A size of very many rows is spread over
    parts by the ``others``.
    """
    prefix = free_prefix([*rows.columns, rank])
    part, row, shift, key = (prefix + n for n in ("part", "row", "shift", "key"))
    placed = in_order(rows, [F.col(size), *[F.col(c) for c in others]], part, row)
    found = placed.groupBy(part, size).agg(F.min(row), F.count("*")).collect()
    before: dict[int, int] = {}
    shifts = []
    for at, value, first, n in sorted(found):
        shifts.append((at, value, before.get(value, 0) - first))
        before[value] = before.get(value, 0) + n
    table = rows.sparkSession.createDataFrame(shifts, f"`{part}` int, `{key}` int, `{shift}` bigint")
    placed = placed.join(F.broadcast(table), [placed[part] == table[part], placed[size] == table[key]]).withColumn(rank, F.col(row) + F.col(shift))
    return placed.select(*rows.columns, rank), before


def new_sequences(spark, changed: list[tuple], first_id: int) -> DataFrame:
    """(id, room) of new sequences that are not full."""
    rows = [(a + first_id, min(a + CHUNK, last) + first_id - 1, left) for room, first, last, left in changed if not room and left for a in range(first, last, CHUNK)]
    chunks = spark.createDataFrame(rows, "first bigint, last bigint, room int")
    return chunks.repartition(max(1, len(rows) // 8), "first").select(F.explode(F.sequence("first", "last")).alias("sequence"), "room")


def best_fit(items: DataFrame, longest: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """The columns of ``items``, ``sequence_id`` (from 0, without gaps) and ``offset``: items of 1 to ``longest`` put whole into sequences of ``longest``.

    The result is that of best-fit decreasing, found in rounds. Items are range-sorted by length and ranked among those of their length once. A round takes the items of a band of lengths,
    longest band first: the gaps of all sequences are range-sorted by room and ranked, a sweep matches ranks of items with ranks of gaps, each item finds its sequence
    by a join on (room, rank), gaps are updated, and the next band follows. There are at most ``1 + log(longest) / log(4)`` rounds, whatever the input. A sweep sees
    the numbers of items and of gaps of each size only, at most ``2 * longest`` numbers in the driver, and its steps, which are broadcast, follow the number of sizes and not that of items.

    Items of one length may be most of all rows: ranks come from a sort that splits them by ``order``. Equal rows and ties of ``order`` are ranked as the sort leaves them,
    once, as every round's tables are written. Null or other lengths raise an error. Without items there are no rows. Columns of ``items`` named like the new ones
    are replaced.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    prefix = free_prefix(items.columns)
    size, rank = prefix + "size", prefix + "rank"
    checked = F.when(F.col(length).between(1, longest), F.col(length).cast("int")).otherwise(F.raise_error(F.lit(f"lengths must be from 1 to {longest}")))
    items, numbers = ranked_by_size(items.withColumn(size, checked), size, [c for c in order if c in items.columns], rank)
    gaps = spark.createDataFrame([], "sequence bigint, room int")
    sequences, high, placed = 0, longest, None
    while high:
        low = high // BAND
        band = {s: n for s, n in numbers.items() if low < s <= high}
        if band:
            holding, counts = ranked_by_size(gaps.where(F.col("room") > low), "room", ["sequence"], "rank") if sequences else (None, {})
            steps, changed, fresh = sweep(band, counts, longest)
            steps = F.broadcast(spark.createDataFrame(steps, TAKES)).alias("s")   # follows the number of sizes
            within = F.col(rank) - F.col("s.first")
            taken = items.where((F.col(size) > low) & (F.col(size) <= high)).alias("i").join(
                steps, (F.col("i." + size) == F.col("s.size")) & (F.col("i." + rank) >= F.col("s.first")) & (F.col("i." + rank) < F.col("s.last")))
            used = F.col("s.used") + within % F.col("s.each") * F.col("s.size")
            capacity = F.when(F.col("s.room") == 0, longest).otherwise(F.col("s.room"))
            taken = taken.select("i.*", F.col("s.room").alias(prefix + "room"), (F.col("s.gap") + F.floor(within / F.col("s.each"))).alias(prefix + "gap"),
                                 (F.lit(longest) - capacity + used).cast("bigint").alias("offset"))
            own = (F.col(prefix + "gap") + sequences).cast("bigint").alias("sequence_id")
            result = taken.where(F.col(prefix + "room") == 0).select(*items.columns, own, "offset")
            if holding is not None:
                old = taken.where(F.col(prefix + "room") > 0).join(holding, (F.col(prefix + "room") == holding["room"]) & (F.col(prefix + "gap") == holding["rank"]))
                result = result.union(old.select(*items.columns, F.col("sequence").alias("sequence_id"), "offset"))
            result = materialize(result)
            placed = result if placed is None else placed.union(result)
            if low:
                fresh_gaps = new_sequences(spark, changed, sequences)
                if holding is not None:
                    runs = F.broadcast(spark.createDataFrame([c for c in changed if c[0]], GAPS)).alias("c")
                    left = holding.alias("h").join(runs, (F.col("h.room") == F.col("c.room")) & (F.col("h.rank") >= F.col("c.first")) & (F.col("h.rank") < F.col("c.last")), "left")
                    left = left.select("sequence", F.coalesce("left", "h.room").alias("room")).where("room > 0")
                    fresh_gaps = left.union(fresh_gaps).union(gaps.where(F.col("room") <= low))
                gaps = materialize(fresh_gaps)
            sequences += fresh
        high = low
    if placed is None:
        placed = items.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))
    return placed.drop(size, rank)
