"""Importance resampling towards a target distribution over hashed word n-grams."""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.ranks import ranked
from codeloom.llm.storage import free_prefix, gathered_rows, materialize, summed
from codeloom.llm.words import Powers, Words, alphanumeric, slices, texts_of

LONG = 64   # bytes; hardly two distinct features of more have the same length, so a matrix of them would be one row


def crc_table() -> np.ndarray:
    """One step of the reflected CRC-32 for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


TABLE = crc_table()


def crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each byte range ``data[start: start + length]``.

    Ranges of equal length are the rows of one matrix of bytes; all CRCs of a matrix are updated column by column and scattered back to the
    places of their ranges. Ranges of more than ``LONG`` bytes go to zlib one by one.
    """
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes, np.split(order, first[1:])):
        if size > LONG:
            out[rows] = [zlib.crc32(data[a: a + size]) for a in start[rows]]
            continue
        matrix = data[start[rows][None, :] + np.arange(size)[:, None]]   # one line of it is one column of bytes
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


def joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slice with one space after each, and where each begins and ends there: a run of words is a range of these bytes."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    shift = np.repeat(start - words.start, length)
    at = np.arange(len(shift)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(words.start, length)
    out[at + shift] = words.data[at]
    return out, start, end


def feature_buckets(words: Words, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each run of ``low`` to ``high`` words and the row that it is in. Each distinct feature is hashed once."""
    data, start, end = joined(words)
    found, rows = [], []
    for n in range(low, high + 1):
        grams, at = (words.hash, np.arange(len(words))) if n == 1 else words.grams(n)
        _, one, inverse = np.unique(grams, return_index=True, return_inverse=True)
        first = at[one]
        crc = crcs(data, start[first], end[first + n - 1] - start[first])
        found.append((crc % np.uint32(buckets)).astype(np.int64)[inverse])
        rows.append(np.searchsorted(words.first, at, "right") - 1)
    return np.concatenate(found), np.concatenate(rows)


def slices_of(column: pa.Array, powers: Powers):
    """(first row, last row, words) for slices of a column."""
    data, bounds = texts_of(column)
    for first, last in slices(bounds):
        yield first, last, Words(data, bounds[first: last + 1], alphanumeric(), powers)


def counter(low: int, high: int, buckets: int):
    def run(batches):
        powers, counts = Powers(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words in slices_of(batch.column(0), powers):
                counts += np.bincount(feature_buckets(words, low, high, buckets)[0], minlength=buckets)
        yield from gathered_rows({0: counts})
    return run


def bucket_counts(texts: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    """How often the features of all texts (one column) fall into each bucket."""
    return summed(texts.mapInArrow(counter(low, high, buckets), "key int, chunk int, counts binary"), 1, buckets)[0]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(ratio of shares))`` of each bucket, all counts raised by one."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + size) / ((int(a) + 1) * (t + size)))) for a, b in zip(source, target)], np.int64)


def weigher(gain, text: int, low: int, high: int, added: list[str]):
    def run(batches):
        powers = Powers()
        for batch in batches:
            size = batch.num_rows
            n_words, n_features, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for first, last, words in slices_of(batch.column(text), powers):
                found, rows = feature_buckets(words, low, high, len(gain.value))
                n_words[first:last] = np.diff(words.first)
                n_features[first:last] = np.bincount(rows, minlength=last - first)
                np.add.at(weight, first + rows, gain.value[found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(n_features), pa.array(weight)], [*batch.schema.names, *added])
    return run


def gumbel(seed: int, id: Column) -> Column:
    """``floor(-1000 * ln(-ln(u)))`` with a uniform number from the id alone; a null id counts as empty."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, low: int = 1, high: int = 1, buckets: int = 10_000, least_words: int = 20,
             seed: int = 2024, id: str = "doc_id", text: str = "text", target_text: str = "text", prefix: str = "__") -> DataFrame:
    """The columns of ``docs`` but the text, and ``__n_words``, ``__n_features``, ``__weight``, ``__score`` and ``__rank``, all long.

    Features are the runs of ``low`` to ``high`` words of a text (words: digits, letters in lower case and non-ASCII bytes), counted as often as they occur,
    hashed into ``buckets`` by CRC-32. A bucket's gain is the log of its share in ``target`` over its share in ``docs``, a text's weight the sum of the
    gains of its features (0 without features), its score the weight plus Gumbel noise made from ``seed`` and the id. Of the documents with at least ``least_words`` words,
    ``percent`` in a hundred (rounded down) are drawn, those of the highest scores, which is a sample without replacement in proportion to the weights; ``__rank`` is their
    place from 1, null for all others.

    Ties go to the smaller id, a null id last, then to the row of fewer features; rows equal in these are drawn in any order. Repeated rows are rows of their own. Null
    and empty texts have no words. Very long texts are whole: a batch is worked in slices, a long text is one slice. Empty ``docs`` give no rows; with an empty
    ``target`` all its counts are 0. ``prefix`` begins the names of new columns; columns of ``docs`` with those names are replaced. All counts are of all rows; tasks send
    their sums by chunks, and the driver gets ``2 * buckets`` numbers and one count per partition of the sort. Distinct features of a slice are told apart by 64-bit hashes.
    """
    if not 1 <= low <= high:
        raise ValueError("runs of words need 1 <= low <= high")
    added = [prefix + n for n in ("n_words", "n_features", "weight")]
    source = bucket_counts(docs.select(text), low, high, buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(source, bucket_counts(target.select(target_text), low, high, buckets)))
    docs = docs.drop(*added, prefix + "score", prefix + "rank")
    schema = ", ".join(f"`{n}` {k}" for n, k in [*docs.dtypes, *((n, "bigint") for n in added)])
    weighed = docs.mapInArrow(weigher(gain, docs.columns.index(text), low, high, added), schema).drop(text)
    score, rank, own = prefix + "score", prefix + "rank", free_prefix([*docs.columns, *added])
    weighed = materialize(weighed.withColumn(score, F.col(added[2]) + gumbel(seed, F.col(id))))
    eligible = weighed.where(F.col(added[0]) >= least_words)
    drawn = percent * eligible.count() // 100
    order = [F.col(score).desc(), F.col(id).asc_nulls_last(), F.col(added[1])]
    placed = ranked(eligible, order, own).withColumn(rank, F.when(F.col(own) <= drawn, F.col(own))).drop(own)
    return placed.unionByName(weighed.where(F.col(added[0]) < least_words).withColumn(rank, F.lit(None).cast("bigint")))
