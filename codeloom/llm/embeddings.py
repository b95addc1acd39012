"""Near duplicates among embeddings by random hyperplanes."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.components import components
from codeloom.llm.storage import materialize

BLOCK_ROWS = 128    # vectors of a bucket that are compared with as many others in one piece
GROUP_ROWS = 1 << 14   # rows of buckets that one call compares, about
PAIRS = 1 << 16     # pairs whose products are taken at once
MISS = 1e-5         # probability that a pair at the threshold shares no table


def planes(seed: int, bits: int, tables: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, bits * tables))


def signer(seed: int, bits: int, tables: int):
    """Unit vectors (as bytes of doubles) and their sign hashes, one per table, for valid rows; null hashes for others."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(2)
            n = len(column)
            units: list = [None] * n
            signs: list = [None] * n
            lengths = np.array([-1 if x is None else x for x in pc.list_value_length(column).to_pylist()])
            for width in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == width)
                flat = column.take(pa.array(rows)).flatten()
                matrix = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)   # null is NaN
                with np.errstate(all="ignore"):
                    peak = np.abs(matrix).max(axis=1, keepdims=True)
                    good = np.isfinite(matrix).all(axis=1) & (peak[:, 0] > 0)
                    unit = matrix[good] / peak[good]
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                if width not in made:
                    made[width] = planes(seed, bits, tables, int(width))
                hashed = ((unit @ made[width] >= 0).reshape(-1, tables, bits) * weights).sum(axis=2)
                for row, u, h in zip(rows[good], unit, hashed):
                    units[row], signs[row] = u.tobytes(), h.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary()), pa.array(signs, pa.list_(pa.int32()))],
                                             ["id", "label", "unit", "signs"])
    return run


def pairs_of(first: np.ndarray, sizes: np.ndarray):
    """Places (i, j), i < j, of all pairs inside runs of rows that begin at ``first`` and have ``sizes`` rows, some at a time. Runs of one size are worked together."""
    for size in np.unique(sizes[sizes > 1]):
        starts = first[sizes == size]
        i, j = np.triu_indices(int(size), 1)
        for a in range(0, len(starts), max(1, PAIRS // len(i))):
            some = starts[a: a + max(1, PAIRS // len(i)), None]
            yield (some + i).ravel(), (some + j).ravel()


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by links: minima over links and jumps over their own result, until nothing changes."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, left, root[right])
        np.minimum.at(least, right, root[left])
        np.minimum.at(least, root, least.copy())   # a root follows the least that any of its own found
        least = least[least]
        if (least == root).all():
            return root
        root = least


def compared(threshold: float):
    """Links of many buckets: how many for each node, counted by its partners' copies, and the smallest node that each reaches by them.

    A pair that meets in several tables counts in the first only. Products of all pairs of a bucket are taken together; those within rounding of the threshold are
    taken again, the same way whatever the bucket.
    """
    def run(table: pa.Table) -> pa.Table:
        node, copies, side, width, bucket, at = (table.column(c).to_numpy() for c in ("node", "copies", "side", "width", "bucket", "table"))
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((at, bucket, width))
        signs = np.array(table.column("signs").to_pylist(), np.int32)
        links, left, right = np.zeros(len(node), np.int64), [], []
        packed = table.column("unit").to_pylist()
        tables = np.arange(signs.shape[1])
        for wide in np.unique(width):
            rows = order[width[order] == wide]
            unit = np.frombuffer(b"".join([packed[i] for i in rows])).reshape(len(rows), -1)
            new = np.concatenate([[True], (np.diff(bucket[rows]) != 0) | (np.diff(at[rows]) != 0), [True]])
            first = np.flatnonzero(new)
            for i, j in pairs_of(first[:-1], np.diff(first)):
                cosine = np.einsum("ij,ij->i", unit[i], unit[j])
                hit = cosine >= threshold - 1e-9
                i, j, cosine = i[hit], j[hit], cosine[hit]
                near = np.abs(cosine - threshold) < 1e-9
                x, y = rows[i], rows[j]
                keep = (label[x] == label[y]) & ((side[x] == 0) | (side[x] != side[y]))
                keep[near] &= (unit[i[near]] * unit[j[near]]).sum(axis=1) >= threshold
                keep &= ~((signs[x] == signs[y]) & (tables < at[x][:, None])).any(axis=1)
                x, y = x[keep], y[keep]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                left.append(x)
                right.append(y)
        # a node has one row in each of its buckets: links join nodes
        names, own = np.unique(node, return_inverse=True)
        total = np.bincount(own, weights=links, minlength=len(names)).astype(np.int64)
        none = np.zeros(0, np.int64)
        root = roots_of(len(names), own[np.concatenate([none, *left])], own[np.concatenate([none, *right])])
        some = np.flatnonzero(total)
        return pa.table({"node": pa.array(names[some]), "links": pa.array(total[some]), "other": pa.array(names[root[some]])})
    return run


def plan_of(rows: int, threshold: float, miss: float, bits: int | None = None) -> tuple[int, int]:
    """Bits if they aren't given, so that a table has about as many signs as there are rows, and tables, so that a pair at the threshold is missed with a probability of at most ``miss``."""
    bits = bits or min(30, max(8, math.ceil(math.log2(max(rows, 2)))))
    share = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-share))) if share < 1 else 1


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, bits: int | None = None, tables: int | None = None, seed: int = 7, id: str = "vec_id",
                    vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``id`` under its own name, ``n_links`` (other vectors linked directly), ``component_id`` (the smallest id reachable) and
    ``kept`` (whether that is its own).

    Vectors of one label link when their cosine in double precision is at least ``threshold``. Candidates are vectors that share all ``bits`` signs of
    at least one of ``tables`` sets of random hyperplanes; each pair found is checked exactly. Two vectors at angle a share a table with probability
    ``(1 - a / pi) ** bits``. Without ``bits`` there is one for each doubling of the number of vectors, so buckets stay as small at any size; without ``tables`` there are as
    many as find a pair at the threshold with a probability of at least 1 - 1e-5, closer ones more surely (20 at ten thousand vectors, about 60 at a hundred million).

    Equal vectors of a label are one node with a number of copies, so a very common vector is compared once. A bucket of many nodes is cut into
    blocks, and pairs of blocks are compared apart; small buckets are compared by many in one call. Links are counted where they are found; only counts and the
    smallest node that each node reaches leave a task. A pair exactly at the threshold links. Null, zero or non-finite vectors and those with a null label link with nothing; vectors of different length never link.
    Rows of one id are vectors of their own that share a component; a row with a null id is a vector that links and is counted, but has a null
    component unless another id reaches it. Other columns are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    made = plan_of(1 if bits else rows.count(), threshold, MISS, bits)
    bits, tables = made[0], tables or made[1]
    signed = rows.mapInArrow(signer(seed, bits, tables), "id bigint, label string, unit binary, signs array<int>")
    signed = materialize(signed.withColumn("digest", F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(),
                                                            F.sha2(F.concat(F.col("unit"), F.encode("label", "UTF-8")), 256))))
    valid = signed.where("digest is not null")
    nodes = valid.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.any_value("label").alias("label"),
                                        F.any_value("unit").alias("unit"), F.any_value("signs").alias("signs"))
    # a node's number: its first digits, distinct but with a probability of n * n / 2**64
    nodes = materialize(nodes.withColumn("node", F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")))
    # the width is part of a bucket: vectors of different length are never compared
    keys = nodes.select("node", "label", F.octet_length("unit").alias("width"), F.posexplode("signs").alias("table", "sign"))
    sizes = keys.groupBy("label", "width", "table", "sign").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = materialize(sizes.select("label", "width", "table", "sign", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), "rows"))
    groups = max(1, (sizes.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0) // GROUP_ROWS)
    keys = keys.join(sizes.drop("rows"), ["label", "width", "table", "sign"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    keys = keys.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    bucket = F.xxhash64("label", "width", "table", "sign", F.least("own", "other"), F.greatest("own", "other"))
    keys = keys.select("node", "label", "width", "table", side.alias("side"), bucket.alias("bucket"))
    members = keys.join(nodes.select("node", "copies", "unit", "signs"), "node").withColumn("group", F.pmod("bucket", F.lit(groups)))
    found = materialize(members.groupBy("group").applyInArrow(compared(threshold), "node bigint, links bigint, other bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> other"), "node", "other")
    # ids: a component's smallest, over all its nodes and over rows that share an id
    named = nodes.select("digest", "node", "copies", "least").join(links, "node", "left").join(joined, "node", "left")
    named = materialize(named.select("digest", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    named = materialize(named.drop("least").join(materialize(least), "component").drop("component"))
    out = signed.select("id", "digest").join(named, "digest", "left").select("id", "n_links", F.coalesce("least", "id").alias("component_id"))
    again = signed.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    if not again.isEmpty():
        out = materialize(out)
        pairs = out.join(again, "id").select("id", "component_id").union(out.where("id is not null and component_id is not null").select("id", "component_id").distinct())
        both = components(pairs, "id", "component_id")
        out = out.join(both, F.col("id") == F.col("node"), "left").select("id", "n_links", F.coalesce("component", "component_id").alias("component_id"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
