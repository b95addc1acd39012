"""An inverted index of the search documents: postings by term in blocks with bounds, and the best matches without reading what can't be among them.

Documents of like length are dealt to the same partitions and numbered in the order of their length there, so that documents of like score lie together, and cut into ranges of
numbers. A block holds postings of one term in one range, with its greatest frequency and least length. For a query the blocks of its terms give an upper bound of the score of every document of a range; ranges whose
bound is below the worst of the best matches found so far are never scored, and their documents never read.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom import constants as C
from codeloom.functions import text
from codeloom.operators.lineage import PACKED, materialize

RANGE = 1 << 12     # documents of a block, at most
FIRST = 4           # ranges that are scored first, those of the highest bounds
NEAR = 1e-9         # scores closer than this are ties
PART_BYTES = 16 << 20    # text of a partition of documents
ROW_BYTES = 64           # what a document counts besides its text
BATCH_BYTES = 8 << 20    # text whose blocks are made at a time


@dataclass(frozen=True)
class TextIndex:
    """``documents``: numbered, in each partition (the high bits of a number) by length and then in the order of ties, with ``range``, ``words`` (each after a space) and ``n_words``. ``blocks``: sorted by (term, range) in each file. ``count`` documents of
    ``mean`` words. ``scored`` tells how many ranges the last search scored, of how many that hold a match."""
    documents: DataFrame
    blocks: DataFrame
    count: int
    mean: float
    scored: list = field(default_factory=list, compare=False)


def index_words(documents: DataFrame) -> DataFrame:
    """Search documents with the words of title, path and body, each after a space, and their number."""
    words = text.search_tokens(F.concat_ws(" ", "title", "path", "body"))
    return (documents.withColumn("_list", words).withColumn("n_words", F.size("_list"))
            .withColumn("words", F.concat(F.lit(" "), F.array_join("_list", " "))).drop("_list"))


def _kept(rows: DataFrame, folder: str | None, name: str) -> DataFrame:
    if folder is None:
        return materialize(rows)
    rows.write.mode("overwrite").options(**PACKED).parquet(f"{folder}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


def load(spark, folder: str) -> TextIndex | None:
    """The index that ``build`` left in a folder; None unless it is whole."""
    try:
        figures = spark.read.parquet(f"{folder}/figures").first()
    except AnalysisException:
        return None
    return TextIndex(spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/blocks"), figures["count"], figures["mean"] or 1.0)


def _dealt(documents: DataFrame) -> DataFrame:
    """Documents in partitions of about ``PART_BYTES`` of text each, those of like length together: neither many short nor a few very long ones meet in one task."""
    size = F.octet_length(F.concat_ws(" ", "title", "path", "body")) + ROW_BYTES
    doubling = F.length(F.bin(size))
    totals = documents.groupBy(doubling.alias("doubling")).agg(F.sum(size).alias("bytes")).orderBy("doubling").collect()   # at most 32 rows
    groups, first, held = [], 0, 0
    for i, r in enumerate(totals):   # few of a length go with the next longer ones
        held += r["bytes"]
        if held >= PART_BYTES or i + 1 == len(totals):
            groups.append((r["doubling"], first, -(-held // PART_BYTES)))
            first, held = first + groups[-1][2], 0
    part, spread = F.lit(0), F.xxhash64("path", "entity_type", "entity_id")
    for upto, start, parts in reversed(groups):
        part = F.when(doubling <= upto, F.lit(start) + F.pmod(spread, F.lit(parts))).otherwise(part)
    return documents.repartitionById(max(first, 1), part.cast("int"))


# on their way to their place numbers go as ``offsets`` from the ``first`` one of the block: those of a block lie within ``RANGE``
BLOCKS = "term string, range long, first long, offsets array<short>, tfs array<int>, sizes array<int>, most int, least int"


def _blocks(size: int):
    """mapInArrow body: documents in the order of their numbers to blocks of ranges of ``size`` numbers; a range that lies in two batches gives a term two blocks."""
    def blocks(batches):
        for whole in batches:
            bytes_ = np.cumsum(pc.fill_null(pc.binary_length(whole["words"]), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(bytes_ // BATCH_BYTES)) + 1 if len(bytes_) else []
            bounds = [0, *cuts, whole.num_rows]
            for start, stop in zip(bounds, bounds[1:]):
                found = _blocks_of_batch(whole.slice(start, stop - start), size)
                if found is not None:
                    yield found
    return blocks


def _blocks_of_batch(batch, size: int):
    listed = pc.split_pattern(batch["words"], " ")
    owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
    words = pc.list_flatten(listed).dictionary_encode()
    terms, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    if not real.any():
        return None
    pairs, tfs = np.unique(codes[real] * batch.num_rows + owner[real], return_counts=True)
    term, row = np.divmod(pairs, batch.num_rows)
    numbers = batch["number"].to_numpy(zero_copy_only=False)[row]
    sizes = batch["n_words"].to_numpy(zero_copy_only=False)[row].astype(np.int32)
    tfs, ranges = tfs.astype(np.int32), numbers // size
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (ranges[1:] != ranges[:-1])])
    cuts = np.r_[starts, len(pairs)]
    offsets = (numbers - np.repeat(numbers[starts], np.diff(cuts))).astype(np.int16)   # rows come in the order of their numbers
    lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values)) for values in (offsets, tfs, sizes)]
    return pa.RecordBatch.from_arrays(
        [terms.take(pa.array(term[starts])), pa.array(ranges[starts]), pa.array(numbers[starts]), *lists, pa.array(np.maximum.reduceat(tfs, starts)), pa.array(np.minimum.reduceat(sizes, starts))],
        names=[c.split()[0] for c in BLOCKS.split(", ")])


def build(documents: DataFrame, folder: str | None = None) -> TextIndex:
    """The index over search documents, kept in ``folder`` or for the session. One exchange of the documents, dealt by the size of their text; the postings of a range lie in one
    partition, so blocks are made where the documents are and only they move: a word of very many documents is spread over its ranges."""
    order = ["n_words", "path", "entity_type", "entity_id", "title", "body"]
    documents = index_words(_dealt(documents)).sortWithinPartitions(*order)
    documents = documents.withColumn("number", F.monotonically_increasing_id()).withColumn("range", F.shiftright("number", RANGE.bit_length() - 1))
    documents = _kept(documents, folder, "documents")
    figures = documents.agg(F.count("*").alias("count"), F.avg("n_words").alias("mean"))
    blocks = documents.select("number", "n_words", "words").mapInArrow(_blocks(RANGE), BLOCKS).repartition("term", "range").sortWithinPartitions("term", "range")
    numbers = F.transform("offsets", lambda offset: F.col("first") + offset)
    blocks = _kept(blocks.select("term", "range", numbers.alias("numbers"), "tfs", "sizes", "most", "least"), folder, "blocks")
    figures = _kept(figures, folder, "figures").first()   # last: an index with figures is whole
    return TextIndex(documents, blocks, figures["count"], figures["mean"] or 1.0)


def phrase_count(words, phrase: str) -> Column:
    """How often words of ``words`` stand in a row, the last as a prefix; occurrences may overlap."""
    return F.regexp_count(words, F.lit(f"(?= \\Q{phrase}\\E)"))


def blocks_of(index: TextIndex, token: str) -> DataFrame:
    """Blocks of a token: of all terms that begin with it, a filter that the scan prunes by. A token of several words has blocks of one document each,
    counted in the documents that hold its first word."""
    if " " not in token:
        return index.blocks.where(F.startswith("term", F.lit(token)))
    first = index.blocks.where(F.col("term") == token.split(" ")[0]).select(F.explode("numbers").alias("number"))
    held = index.documents.join(first, "number", "left_semi").withColumn("tf", phrase_count("words", token)).where("tf > 0")
    return held.select(F.lit(token).alias("term"), "range", F.array("number").alias("numbers"), F.array("tf").alias("tfs"), F.array("n_words").alias("sizes"),
                       F.col("tf").alias("most"), F.col("n_words").alias("least"))


def part_of(tf: Column, size: Column, idf: Column, mean: float) -> Column:
    return idf * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * size / F.lit(mean)))


class Query:
    """A list of folded tokens against an index."""

    def __init__(self, index: TextIndex, tokens: list[str]):
        self.index, self.tokens = index, tokens
        blocks = [blocks_of(index, t).withColumn("token", F.lit(i)) for i, t in enumerate(tokens)]
        self.blocks = blocks[0]
        for more in blocks[1:]:
            self.blocks = self.blocks.unionByName(more)
        # a document with several terms of a token counts once; at most the postings of a range meet in a group
        counted = F.size(F.array_distinct(F.flatten(F.collect_list("numbers"))))
        self.bounds = materialize(self.blocks.groupBy("range", "token").agg(F.sum("most").alias("most"), F.min("least").alias("least"), counted.alias("n")))
        frequency = {r["token"]: r["n"] for r in self.bounds.groupBy("token").agg(F.sum("n").alias("n")).collect()}   # one row a token
        self.idf = []
        for i in range(len(tokens)):
            df = frequency.get(i, 0)
            idf = math.log((index.count - df + 0.5) / (df + 0.5))
            self.idf.append(idf if idf > 0 else C.BM25_IDF_FLOOR)

    def by_token(self, values) -> Column:
        out = F.lit(0.0)
        for i, value in enumerate(values):
            out = F.when(F.col("token") == i, value).otherwise(out)
        return out

    def ranges(self) -> DataFrame:
        """(range, bound): no document of the range has a higher score."""
        bound = part_of(F.col("most"), F.col("least"), self.by_token(map(F.lit, self.idf)), self.index.mean)
        return self.bounds.groupBy("range").agg(F.sum(bound).alias("bound"))

    def scores(self, chosen: Column | None = None, ranges: DataFrame | None = None) -> DataFrame:
        """(number, range, size, score) of the documents of the chosen ranges, highest scores best."""
        blocks = self.blocks if chosen is None else self.blocks.where(chosen)
        blocks = blocks if ranges is None else blocks.join(ranges.select("range"), "range", "left_semi")
        rows = blocks.select("token", "range", F.explode(F.arrays_zip("numbers", "tfs", "sizes")).alias("r"))
        tf = [F.sum(F.when(F.col("token") == i, F.col("r.tfs")).otherwise(0)).alias(f"tf{i}") for i in range(len(self.tokens))]
        rows = rows.groupBy("range", F.col("r.numbers").alias("number")).agg(F.first("r.sizes").alias("size"), *tf)
        score = F.lit(0.0)
        for i, idf in enumerate(self.idf):
            score = score + part_of(F.col(f"tf{i}"), F.col("size"), F.lit(idf), self.index.mean)
        return rows.select("number", "range", "size", score.alias("score"))

    def documents(self, scores: DataFrame, chosen: Column | None = None) -> DataFrame:
        rows = self.index.documents if chosen is None else self.index.documents.where(chosen)
        return rows.drop("words", "n_words", "range").join(scores.drop("range", "size"), "number").withColumn("bm25", -F.col("score"))

    def matches(self) -> DataFrame:
        """All documents that hold a token, with ``bm25`` (lower is better)."""
        return self.documents(self.scores()).drop("number", "score")

    def best(self, limit: int, keep: Column | None, order: list) -> DataFrame:
        """The first ``limit`` matches in ``order`` of those that ``keep`` chooses. ``order`` goes by the score first and then as documents of a length are numbered.

        The ranges of the highest bounds are scored and filtered first; the score of their worst match in the first ``limit`` bounds the rest from below, and only ranges that can
        reach it are scored. Without so many matches in the first ranges the rest is scored whole: nothing is lost. Documents are read last, for what can still be shown.
        """
        ranges = materialize(self.ranges())
        first = [r["range"] for r in ranges.orderBy(F.desc("bound"), "range").limit(FIRST).collect()]
        early = F.col("range").isin(first)
        near = self.documents(self.scores(early), early)
        near = near if keep is None else near.where(keep)
        near = materialize(near.orderBy(*order).limit(limit))
        found = near.agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        least = found["score"] - NEAR if found["n"] == limit else 0.0
        rest = ranges.where(~early & (F.col("bound") >= least))
        counts = ranges.agg(F.count("*").alias("all"), F.count_if(~early & (F.col("bound") >= least)).alias("rest")).first()
        self.index.scored[:] = [len(first) + counts["rest"], counts["all"]]
        if counts["rest"]:
            near = near.unionByName(self.documents(self._leading(rest, keep, limit, least)))
        return near.orderBy(*order).limit(limit).drop("number", "score")

    def _leading(self, ranges: DataFrame, keep: Column | None, limit: int, least: float) -> DataFrame:
        """(number, range, size, score) of the documents of the ranges that can be among the first ``limit`` of them, by scores and numbers alone.

        Only numbers of chosen documents meet the scores. Of equal score and length, documents of a partition are in the order of their numbers.
        """
        ranges = materialize(ranges.select("range"))
        scores = self.scores(None, ranges).where(F.col("score") >= least)
        if keep is not None:
            scores = scores.join(self.index.documents.join(ranges, "range", "left_semi").where(keep).select("number"), "number", "left_semi")
        scores = materialize(scores)
        top = scores.select("score").orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        if top["n"] == limit:
            scores = scores.where(F.col("score") >= top["score"] - NEAR)
        place = F.row_number().over(Window.partitionBy(F.shiftright("number", 33), "size", "score").orderBy("number"))
        return materialize(scores.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place"))


def folded(spark, tokens: list[str]) -> list[str]:
    """Query tokens as words of the index; one of several words asks for them in a row, the last as a prefix. A constant expression, so no job runs."""
    asked = spark.sql("SELECT 1").select(*(F.array_join(text.search_tokens(F.lit(t)), " ") for t in tokens)).first()
    return [words for words in asked if words]


def as_index(documents) -> TextIndex:
    return documents if isinstance(documents, TextIndex) else build(documents)
