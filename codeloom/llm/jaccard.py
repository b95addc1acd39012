"""N-gram Jaccard join: classes of texts linked by their distinct word n-grams.

Global order of n-grams: rare first, by the number of sets that hold an n-gram of the same bucket, then by hash. Two sets that
link share an n-gram among the first ``n - ceil(threshold * n) + 1`` of each (their prefixes). Candidates that share one are
verified together, in blocks, by a trie of their globally ordered sets (there frequent first, so that near copies share
long paths).
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.components import components
from codeloom.llm.storage import free_prefix, gathered_rows, materialize, summed
from codeloom.llm.words import Powers, Words, mix, not_space, shingle_sets, slices, texts_of

BUCKETS = 1 << 18       # of the n-gram order: 2 MB, whatever the size of the input
LEAST_BITS = 512        # of a set's parities
LEAST_CELL = 1 << 12    # sets of a cell of an n-gram
WANTED_BITS = 1 << 24   # 2 MB, whatever the size of the input
BLOCK_GRAMS = 1 << 19   # n-grams and
BLOCK_ROWS = 64         # sets that one verification holds, about


def sets_of(column: pa.Array, k: int, powers: Powers):
    """The sorted shingle hashes of each row."""
    data, offsets = texts_of(column)
    for first, last in slices(offsets):
        yield from shingle_sets(Words(data, offsets[first: last + 1], not_space(), powers), k)


def buckets(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64)


def ordered(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set in the global order."""
    return grams[np.argsort(counts[buckets(grams)], kind="stable")]


def parities(grams: np.ndarray) -> bytes:
    """For each of a power of two of buckets (at least ``LEAST_BITS`` and as many as n-grams) the parity of the n-grams in it, as bits."""
    size = max(LEAST_BITS, 1 << (len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def could_overlap(n1: int, bits1: bytes, n2: int, bits2: bytes, percent: int) -> bool:
    """Whether sets can link by their parities: each bit that differs is an n-gram that only one of them has. The larger is folded to the size of
    the smaller; folding parities is adding them."""
    x, y = np.frombuffer(bits1, np.uint8), np.frombuffer(bits2, np.uint8)
    small = min(len(x), len(y))
    differ = np.bitwise_xor.reduce(x.reshape(-1, small)) ^ np.bitwise_xor.reduce(y.reshape(-1, small))
    most = (n1 + n2 - int(np.bitwise_count(differ).sum())) // 2
    return most * (100 + percent) >= percent * (n1 + n2)


def summaries(k: int):
    def run(batches):
        powers = Powers()
        for batch in batches:
            rows = [(len(g), blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None, parities(g) if len(g) else None) for g in sets_of(batch.column(1), k, powers)]
            sizes, digests, bits = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary())], ["id", "n", "digest", "bits"])
    return run


def bucket_counts(k: int):
    def run(batches):
        powers, counts = Powers(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for grams in sets_of(batch.column(0), k, powers):
                counts += np.bincount(buckets(grams), minlength=BUCKETS) if len(grams) > BUCKETS // 64 else 0
                if len(grams) <= BUCKETS // 64:
                    np.add.at(counts, buckets(grams), 1)
        yield from gathered_rows({0: counts})
    return run


def cells_of(counts: np.ndarray) -> np.ndarray:
    """Into how many cells the sets that hold an n-gram of a bucket are spread: 1, but for buckets of very many more sets than the mean."""
    return -(-counts // max(LEAST_CELL, 16 * int(counts.mean())))


def prefixes(k: int, counts, percent: int):
    """(id, n, gram, place, cell): the prefix of each set, the place of each n-gram in the ordered set, and 0 or, for an n-gram of a bucket with several cells, the cell
    (from 1) that the set's own hash gives: equal sets are in one cell."""
    def run(batches):
        powers, cells = Powers(), cells_of(counts.value)
        for batch in batches:
            sizes, own, grams_of = [], [], []
            for grams in sets_of(batch.column(1), k, powers):
                n = len(grams)
                sizes.append(n)
                own.append(int(mix(grams).sum(dtype=np.uint64) >> np.uint64(1)))
                grams_of.append(ordered(grams, counts.value)[: n + (-percent * n // 100) + 1] if n else grams)
            lengths = np.array([len(g) for g in grams_of], np.int64)
            at = np.repeat(np.arange(len(sizes)), lengths)
            place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            grams = np.concatenate([*grams_of, np.zeros(0, np.uint64)])
            several = cells[buckets(grams)]
            cell = np.where(several > 1, 1 + np.array(own, np.int64)[at] % np.maximum(several, 1), 0).astype(np.int32)
            grams = grams.view(np.int64)
            for i in range(0, len(at), 1 << 20):
                part = slice(i, i + (1 << 20))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[part])), pa.array(np.array(sizes, np.int32)[at[part]]),
                                                  pa.array(grams[part]), pa.array(place[part].astype(np.int32)), pa.array(cell[part])],
                                                 ["id", "n", "gram", "place", "cell"])
    return run


class Trie:
    """Globally ordered sets in a compressed prefix tree.

    A node is a run of n-grams that the same sets share, its children, and the sets that end there; ``longest`` and ``shortest``
    bound the sizes of the sets below.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._node(order, 0)

    def _node(self, members: list[int], depth: int):
        """Members are neighbours in order and share their first ``depth`` n-grams. Built with a stack: depth is unbounded."""
        root: list = []
        todo = [(members, depth, root)]
        while todo:
            members, depth, into = todo.pop()
            low, high = self.sets[members[0]], self.sets[members[-1]]
            m = min(len(low), len(high))
            differ = np.flatnonzero(low[depth:m] != high[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            sizes = [len(self.sets[i]) for i in members]
            children: list = []
            into.append((low[depth:end], [i for i in members if len(self.sets[i]) == end], children, min(sizes), max(sizes)))
            rest = [i for i in members if len(self.sets[i]) > end]
            heads = [int(self.sets[i][end]) for i in rest]
            a = 0
            for b in range(1, len(rest) + 1):
                if b == len(rest) or heads[b] != heads[a]:
                    todo.append((rest[a:b], end, children))
                    a = b
        return root[0]

    def linked(self, probe: np.ndarray, percent: int):
        """Sets that link with ``probe``: the overlap of a path is shared by all sets below it, and a subtree is left as soon
        as the n-grams that remain can't lift the overlap to what the shortest set below would need."""
        n, member = len(probe), np.sort(probe)
        todo = [(self.root, 0, 0)]
        while todo:
            (grams, ends, children, shortest, longest), overlap, depth = todo.pop()
            if len(grams):
                at = np.searchsorted(member, grams)
                overlap += int((member[np.minimum(at, n - 1)] == grams).sum())
            depth += len(grams)
            # overlap >= percent * (n + size) / (100 + percent), with size at least shortest; missed: n-grams of the path that the probe lacks
            missed = depth - overlap
            most = min(n, longest - missed)
            if most * (100 + percent) < percent * (n + max(shortest, depth)):
                continue
            if overlap * (100 + percent) >= percent * (n + depth):
                yield from ends
            todo.extend((child, overlap, depth) for child in children)


def verify(k: int, counts, percent: int):
    """One block: texts of a pivot and its candidates. Yields a spanning forest of the links between all of them."""
    powers = Powers()

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        column = table.column("text").combine_chunks()
        sets = [ordered(g, counts.value)[::-1] for g in sets_of(column, k, powers)]
        parent = list(range(len(ids)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        rows = [i for i in range(len(ids)) if len(sets[i])]
        left, right = [], []
        if rows:
            trie = Trie([sets[i] for i in rows])
            for i in rows:
                for j in trie.linked(sets[i], percent):
                    a, b = root(i), root(rows[j])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        left.append(ids[i])
                        right.append(ids[rows[j]])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})
    return run


def links_of(pairs: DataFrame, texts: DataFrame, k: int, counts, percent: int) -> DataFrame:
    """Links found among the blocks of candidate ``pairs`` (pivot ``a``, other ``b``). A pivot with many others is spread
    over several blocks by their number and size; the pivot is in each, every pair of the pivot is verified, and so is any
    pair that meets in a block."""
    others = pairs.join(texts.select(F.col("id").alias("b"), "n"), "b")
    most = F.ceil(F.greatest(F.sum("n") / BLOCK_GRAMS, F.count("*") / BLOCK_ROWS))
    blocks = materialize(others.groupBy("a").agg(most.cast("bigint").alias("blocks")))
    others = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.col("b").alias("id"))
    pivots = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("id"))
    members = others.union(pivots).join(texts.select("id", "text"), "id")
    return members.groupBy("a", "block").applyInArrow(verify(k, counts, percent), "a bigint, b bigint")


def could_link(x: str, y: str, percent: int):
    """Whether sets can link by their sizes and the places of an n-gram that is the first they share."""
    most = 1 + F.least(F.expr(f"{x}.n - {x}.place - 1"), F.expr(f"{y}.n - {y}.place - 1"))
    return most * (100 + percent) >= F.expr(f"{x}.n + {y}.n") * percent


def apart(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share an n-gram of their prefixes and could still link. The conditions are part of the join: pairs that
    fail them are never rows, and adaptive execution can split an n-gram of very many sets."""
    mixed = entries.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    entries = materialize(entries.join(materialize(mixed.select("gram")), "gram"))
    x, y = entries.alias("x"), entries.alias("y")
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & F.expr("x.component <> y.component and (x.n < y.n or x.n = y.n and x.id < y.id)")
                   & could_link("x", "y", percent))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def plausible(percent: int):
    """Pairs (a, b, an, abits, bn, bbits) to the (a, b) that can link by their parities."""
    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]))
            keep = pa.array([could_overlap(*row, percent) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def pruned(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of which any versions can link by their parities, before a text is moved."""
    known = sizes.where("id is not null and bits is not null")
    x, y = known.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits")), known.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "an", "abits", "bn", "bbits").mapInArrow(plausible(percent), "a bigint, b bigint").distinct()


def hashes(batches):
    """The hashes (one column) of a task as bits, in pieces that hold any."""
    bits = np.zeros(WANTED_BITS, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy()] = True
    packed = np.packbits(bits)
    pieces = [(i, piece.tobytes()) for i, piece in enumerate(np.split(packed, len(packed) // 4096)) if piece.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([p for _, p in pieces], pa.binary())], ["piece", "bits"])


def either(batches):
    """Pieces of one number, put together."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, bits in zip(*(c.to_pylist() for c in batch.columns)):
            found[piece] = found.get(piece, np.uint8(0)) | np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["piece", "bits"])


def texts_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, text) of the ``wanted`` (id, n). Most texts are dropped where they are read, by a bit of their id's hash; a join follows for the rest."""
    spot = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS))
    pieces = wanted.select(spot.alias("spot")).mapInArrow(hashes, "piece int, bits binary").repartition("piece").mapInArrow(either, "piece int, bits binary").toArrow()
    packed = np.zeros(WANTED_BITS // 8, np.uint8)
    for piece, bits in zip(*(c.to_pylist() for c in pieces.columns)):
        packed[piece * 4096: (piece + 1) * 4096] = np.frombuffer(bits, np.uint8)
    packed = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        bits = np.unpackbits(packed.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(pa.array(bits[batch.column(2).to_numpy()] == 1))
    some = docs.where("id is not null").select("id", "text", spot.alias("spot")).mapInArrow(run, "id bigint, text string, spot bigint")
    return materialize(some.select("id", "text").join(wanted, "id").select("id", "n", "text"))


def verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, k: int, counts, percent: int) -> DataFrame:
    """The links among candidate ``pairs`` (a, b): first by parities, then by the sets."""
    pairs = materialize(pruned(pairs, sizes, percent))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = materialize(sizes.join(wanted, "id").groupBy("id").agg(F.max("n").alias("n")))
    return materialize(links_of(pairs, texts_with(docs, wanted), k, counts, percent))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id`` under its own name, ``n_shingles`` and ``component_id``.

    Words are runs of other bytes than white space, A-Z in lower case; a text's set holds its distinct ``k``-word shingles, or all of its words as
    one if they are fewer. Two texts link when ``100 * shared >= percent * united``; ``component_id`` is the smallest id that is
    reachable by links. Empty and null texts have no shingles and link with nothing.

    Equal sets are one class from the start. Candidates of an n-gram are first verified against its smallest id only, which joins
    groups of near copies in linear work; after that, only pairs of different components are candidates, all of
    which are verified: no link between components is lost. An n-gram of very many sets is spread over cells by the sets' hashes, each with a pivot of
    its own. Candidates are first tested by parities of their n-grams (about a bit each), which bound the overlap from above; only texts of what is left are fetched and compared.

    Rows of one id are versions of one document: what one of them links with, all reach. A row with a null id keeps its size, gets a null
    component and links with nothing. Other columns are ignored; ids must be integers. Very long texts are whole: a long text is a slice of its own. An empty table gives no rows. Shingles are compared by
    64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    sizes = materialize(docs.mapInArrow(summaries(k), "id bigint, n bigint, digest binary, bits binary"))
    classes = materialize(sizes.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep")))
    counts = summed(docs.select("text").mapInArrow(bucket_counts(k), "key int, chunk int, counts binary"), 1, BUCKETS)[0]
    counts = spark.sparkContext.broadcast(counts)   # BUCKETS numbers

    # one exchange: both sides of the join are of the same partitioning by n-gram, and hold all of its columns
    moved = docs.where("id is not null").mapInArrow(prefixes(k, counts, percent), "id bigint, n int, gram bigint, place int, cell int").repartition("gram", "cell")
    pivots = moved.groupBy("gram", "cell").agg(F.min(F.struct("id", "n", "place")).alias("p"), F.max("id").alias("z")).where("p.id < z or cell > 0").drop("z")
    entries = materialize(moved.join(pivots.hint("merge"), ["gram", "cell"]).select("gram", "cell", "id", "n", "place", "p"))
    reps = classes.select(F.col("rep").alias("id")).distinct()
    star = entries.alias("e").where("p.id < e.id").where(could_link("p", "e", percent)).select(F.col("p.id").alias("a"), F.col("e.id").alias("b"))
    # pivots of the cells of one n-gram
    cells = materialize(entries.where("cell > 0").select("gram", "p").distinct())
    heads = cells.groupBy("gram").agg(F.min("p").alias("h"))
    over = cells.join(heads, "gram").where("h.id < p.id").where(could_link("h", "p", percent)).select(F.col("h.id").alias("a"), F.col("p.id").alias("b"))
    star = star.union(over).distinct().join(reps, F.col("b") == F.col("id"), "left_semi")
    links = verified(star, docs, sizes, k, counts, percent)

    joined = components(links, "a", "b").withColumnRenamed("node", "id")
    state = materialize(reps.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    rest = apart(materialize(entries.select("gram", "id", "n", "place").join(state, "id")), percent)
    more = verified(rest, docs, sizes, k, counts, percent)

    again = sizes.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    versions = sizes.join(again, "id").join(classes, "digest").select("id", "rep").distinct()
    versions = versions.join(versions.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b"))
    joined = components(links.union(more).union(versions), "a", "b")
    classes = materialize(classes.join(joined, classes["rep"] == joined["node"], "left").select("digest", F.coalesce("component", "rep").alias("component")))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return sizes.join(classes, "digest", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, of equal rows or versions the one of the smallest
    text. Rows with a null id and documents without words stay."""
    found = jaccard_components(docs, k, percent, id, text)
    gone, again, row = (free_prefix(docs.columns) + name for name in ("gone", "again", "row"))
    left = docs.join(found.where(F.col(id) > F.col("component_id")).select(F.col(id).alias(gone)).distinct(), F.col(id) == F.col(gone), "left_anti")
    several = found.where(F.col(id).isNotNull()).groupBy(id).count().where("count > 1").select(F.col(id).alias(again))
    if several.isEmpty():
        return left
    single = left.join(several, F.col(id) == F.col(again), "left_anti")
    repeated = left.join(several, F.col(id) == F.col(again), "left_semi")
    worded = F.coalesce(F.length(F.regexp_replace(F.col(text), "[\\x20\\x09-\\x0D]+", "")), F.lit(0)) > 0
    first = repeated.where(worded).groupBy(F.col(id).alias(gone)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text).alias(row))
    return single.union(repeated.where(~worded)).union(first.select(f"{row}.*"))
