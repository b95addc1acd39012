"""Benchmark decontamination by a broadcast set of n-gram windows."""

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.storage import free_prefix, materialize
from codeloom.llm.words import Powers, Words, alphanumeric, slices, texts_of

BLOCK_BYTES = 4 << 20   # benchmark text whose windows one scan holds
FILTER_BITS = 22


def windows_of(items: list[tuple], n: int) -> dict:
    """Windows of benchmark items of one block, per length: sorted hashes, a table of their low bits, and for each the window's words and
    its items. Plain data, to be broadcast."""
    powers, keep = Powers(), alphanumeric()
    found: dict[int, dict] = {}
    data, offsets = texts_of(pa.array([text for _, text in items], pa.string()))
    for first, last in slices(offsets):
        words = Words(data, offsets[first: last + 1], keep, powers)
        grams, at = words.grams(n)
        rows = np.searchsorted(words.first, at, "right") - 1
        windows = [(n, int(h), int(i), first + int(r)) for h, i, r in zip(grams, at, rows)]
        for row in range(last - first):
            have = int(words.first[row + 1] - words.first[row])
            if 0 < have < n:
                windows.append((have, int(words.whole(row)), int(words.first[row]), first + row))
        for size, value, i, row in windows:
            found.setdefault(size, {}).setdefault((value, joined(words, i, size)), set()).add(items[row][0])
    tables = {}
    for size, windows in found.items():
        order = sorted(windows)
        hashes = np.array([h for h, _ in order], np.uint64)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[low_bits(hashes)] = True
        tables[size] = hashes, np.packbits(seen), [(key[1], sorted(i for i in windows[key] if i is not None)) for key in order]
    return tables


def low_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def hits(tables: dict, words: Words):
    """Verified occurrences: (first word, length, items)."""
    for size, (hashes, seen, contents) in tables.items():
        grams, at = words.grams(size)
        maybe = np.flatnonzero(seen[low_bits(grams)])
        left = np.searchsorted(hashes, grams[maybe])
        right = np.searchsorted(hashes, grams[maybe], "right")
        for j in np.flatnonzero(right > left):
            i = int(at[maybe[j]])
            content = joined(words, i, size)
            for k in range(left[j], right[j]):
                if contents[k][0] == content:
                    yield i, size, contents[k][1]


def joined(words: Words, i: int, size: int) -> bytes:
    return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[i: i + size], words.end[i: i + size]))


COLUMNS = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<bigint>"), ("spans", "array<struct<start:int,end:int>>")]


def scanner(windows, text: int, keep_columns: int, names: list[str]):
    """Adds ``COLUMNS`` to the first columns of batches; spans and items that an earlier scan left there are kept."""
    def run(batches):
        powers, keep = Powers(), alphanumeric()
        tables = {size: (hashes, np.unpackbits(seen).view(bool), contents) for size, (hashes, seen, contents) in windows.value.items()}
        for batch in batches:
            data, offsets = texts_of(batch.column(text))
            rows = batch.num_rows
            n_words, n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            items: list[list] = [[]] * rows
            spans: list[list] = [[]] * rows
            before = None
            if batch.num_columns > keep_columns:
                before = batch.column(keep_columns + 2).to_pylist(), batch.column(keep_columns + 3).to_pylist()
            for first, last in slices(offsets):
                words = Words(data, offsets[first: last + 1], keep, powers)
                n_words[first:last] = np.diff(words.first)
                change = np.zeros(len(words) + 1, np.int64)
                seen: dict[int, set] = {}
                for i, size, ids in hits(tables, words):
                    change[i] += 1
                    change[i + size] -= 1
                    row = int(np.searchsorted(words.first, i, "right")) - 1
                    seen.setdefault(row, set()).update(ids)
                for row in range(last - first) if before else ():
                    seen.setdefault(row, set()).update(before[0][first + row])
                    base, a = int(offsets[first + row] - offsets[first]), words.first[row]
                    starts, ends = words.start[a: words.first[row + 1]] - base, words.end[a: words.first[row + 1]] - base
                    for span in before[1][first + row]:
                        change[a + np.searchsorted(starts, span["start"])] += 1
                        change[a + np.searchsorted(ends, span["end"]) + 1] -= 1
                hit = np.cumsum(change)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit[first:last] = np.diff(total[words.first])
                for row, ids in seen.items():
                    a, b = words.first[row], words.first[row + 1]
                    edges = np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))
                    base = int(offsets[first + row] - offsets[first])
                    items[first + row] = sorted(ids)
                    spans[first + row] = [{"start": int(words.start[a + s]) - base, "end": int(words.end[a + e - 1]) - base}
                                          for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep_columns], pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.int64())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                [*batch.schema.names[:keep_columns], *names])
    return run


def cut_items(n: int, most: int):
    """Items (id, text) of more than ``most`` bytes to several of about that size that hold the same windows: each begins with the last ``n - 1`` words of the one before."""
    def run(batches):
        powers, keep = Powers(), alphanumeric()
        for batch in batches:
            rows = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if len(text.encode()) <= most:
                    rows.append((i, text))
                    continue
                words = Words(*texts_of(pa.array([text])), keep, powers)
                a = 0
                while a < len(words):
                    b = int(np.searchsorted(words.end, words.start[a] + most, "right"))
                    b = min(max(b, a + n), len(words))
                    rows.append((i, joined(words, a, b - a).decode()))
                    a = len(words) if b == len(words) else b - n + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["id", "text"])
    return run


def find_leaks(docs: DataFrame, bench: DataFrame, n: int = 10, text: str = "text", item: str = "item_id",
               item_text: str = "text", block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """The columns of ``docs`` and, for each row, ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``items`` (distinct ids of benchmark items with occurring windows) and ``spans`` (byte ranges of runs of hit words).

    The windows of the benchmark are broadcast as hash tables, about ``block_bytes`` of benchmark text at a time. A larger benchmark is scanned in several
    blocks: the rows with what was found so far are written before the windows of the next block are made, and those of the last are freed, so the driver and the
    tasks hold one block at any time. An item larger than a block is cut into several that share ``n - 1`` words. The documents are never shuffled. A hash that is found is
    verified on the words themselves, so which of several windows of one hash is met first doesn't matter.

    A null text has no words. Items without text or words have no window; an item without id marks words but is not
    listed; items of equal id are one item. Very long texts are scanned whole, a text a slice; without rows there is no result, and without items no word is hit.
    ``prefix`` goes before the names of the new columns; columns of ``docs`` with those names are replaced. Repeated rows are kept.
    """
    spark = docs.sparkSession
    names = [prefix + name for name, _ in COLUMNS]
    docs = docs.drop(*names)
    bench = bench.select(F.col(item).cast("bigint").alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(size / block_bytes))
    if blocks > 1:
        bench = materialize(bench.mapInArrow(cut_items(n, block_bytes), "id bigint, text string"))
    width, at = len(docs.columns), docs.columns.index(text)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*docs.dtypes, *zip(names, (kind for _, kind in COLUMNS))])
    out = docs
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow()
        windows = spark.sparkContext.broadcast(windows_of(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), n))
        out = out.mapInArrow(scanner(windows, at, width, names), schema)
        if block + 1 < blocks:
            out = materialize(out)
            windows.destroy()
    return out


def remove_leaks(docs: DataFrame, bench: DataFrame, by: str = "document", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an occurrence (``by="document"``), or with the hit spans cut out of
    their texts (``by="span"``)."""
    prefix = free_prefix(docs.columns)
    found = find_leaks(docs, bench, text=text, prefix=prefix, **options)
    if by == "document":
        return found.where(F.col(prefix + "n_hit") == 0).select(*docs.columns)
    raw, spans = F.encode(F.col(text), "UTF-8"), F.col(prefix + "spans")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    parts = F.zip_with(starts, ends, lambda s, e: F.decode(F.substring(raw, s + 1, e - s), "UTF-8"))
    clean = F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(F.col(text))
    return found.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
