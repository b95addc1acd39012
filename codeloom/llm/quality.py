"""Quality by the votes of the nearest labelled documents in a latent semantic space."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.storage import give_back, held_out
from codeloom.llm.words import Powers, Words, alphanumeric, lowered, slices, texts_of

TERMS, LETTERS, SHAPES = 4096, 2048, 2048   # hashed words and pairs of words; runs of letters; shapes
FEATURES = TERMS + LETTERS + SHAPES
BLOCK = 256   # documents of one matrix product


def classes() -> np.ndarray:
    """Byte table for the shape of a text: letters by case, digits, non-ASCII letters and line ends become one byte each, punctuation
    and spaces stay."""
    table = np.arange(256, dtype=np.uint8)
    table[48:58], table[65:91], table[97:123], table[128:] = ord("0"), ord("A"), ord("a"), ord("a")
    table[9:14] = table[:9] = table[14:32] = ord("\n")
    return table


def runs(codes: np.ndarray, left: np.ndarray, row: np.ndarray, rows: int, width: int, factor: int, size: int) -> np.ndarray:
    """Counts of hashed runs of ``width`` bytes within each text."""
    n = len(row)
    code = np.zeros(n, np.uint32)
    for i in range(width):
        code = code * np.uint32(257) + codes[i: n + i]
    code = (code * np.uint32(factor)) >> np.uint32(33 - size.bit_length())
    good = left >= width
    return np.bincount(row[good] * size + code[good], minlength=rows * size).reshape(rows, size)


def features(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    """For each text of a slice three parts, each of square roots of shares: its hashed words and pairs of words; runs of three bytes in lower case; and shapes, which are pairs and runs
    of four of shape bytes, and words that repeat the word before, or are like it. All bytes of a text count. An empty text is zero."""
    rows = len(offsets) - 1
    body, base = data[offsets[0]: offsets[-1]], offsets - offsets[0]
    n = len(body)
    row = np.repeat(np.arange(rows), np.diff(base))
    left = np.repeat(base[1:], np.diff(base)) - np.arange(n)
    words = Words(data, offsets, alphanumeric(), powers)
    terms = np.zeros((rows, TERMS), np.int64)
    for size in (1, 2):
        grams, at = words.grams(size)
        owner = np.searchsorted(words.first, at, "right") - 1
        terms += np.bincount(owner * TERMS + (grams % np.uint64(TERMS)).astype(np.int64), minlength=rows * TERMS).reshape(rows, TERMS)
    tail = np.zeros(4, np.uint8)
    letters = runs(np.concatenate([lowered()[body], tail]).astype(np.uint32), left, row, rows, 3, 0xC2B2AE35, LETTERS)
    shape = np.concatenate([classes()[body], tail]).astype(np.uint32)
    shapes = np.concatenate([runs(shape, left, row, rows, width, factor, SHAPES // 2) for width, factor in ((2, 0x9E3779B1), (4, 0x85EBCA77))], axis=1)
    # a word like the word before it: of equal length and equal sum of squared bytes
    space = np.concatenate([[True], (body == 32) | (body == 10), [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    squares = np.concatenate([[0], np.cumsum(body.astype(np.int64) ** 2)])
    weight, owner = squares[ends] - squares[starts], np.searchsorted(base, starts, "right") - 1
    same = (weight[1:] == weight[:-1]) & (np.diff(ends) == np.diff(starts)) & (owner[1:] == owner[:-1])
    shapes[:, 0] += 4 * np.bincount(owner[1:][same], minlength=rows)
    return np.concatenate([np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)).astype(np.float32) for x in (terms, letters, shapes)], axis=1)


def weighted(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Features times their rarity, each of the three parts brought to length one, so that shapes are a third. Works in place."""
    rows *= rarity
    for part in np.split(rows, [TERMS, TERMS + LETTERS], axis=1):
        part[:] = units(part)
    return rows


def feature_rows(batches):
    """Rows (order, label, text) to (order, label, places, values): the features that are not zero, in 6 bytes each."""
    powers = Powers()
    for batch in batches:
        data, offsets = texts_of(batch.column(2))
        for first, last in slices(offsets):
            for a in range(first, last, BLOCK):
                b = min(a + BLOCK, last)
                rows = features(data, offsets[a: b + 1], powers)
                places = [np.flatnonzero(r).astype("<u2") for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([at.tobytes() for at in places], pa.binary()),
                                                  pa.array([r[at].tobytes() for r, at in zip(rows, places)], pa.binary())], ["order", "label", "places", "values"])


class Sample:
    """The features of the labelled sample, sparse; at most ``BLOCK`` rows are spread out at a time."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table.column("order").to_numpy(), table.column("label").to_numpy()))
        self.marks = table.column("label").to_numpy()[order]
        self.places, self.values = (np.frombuffer(b"".join(c.as_py() for c in table.column(name).take(pa.array(order))), kind)
                                    for name, kind in (("places", "<u2"), ("values", np.float32)))
        sizes = np.array([len(c.as_py()) // 2 for c in table.column("places")], np.int64)[order]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.rarity = np.log((1 + len(self)) / (1 + np.bincount(self.places, minlength=FEATURES))).astype(np.float32) + np.float32(0.1)   # none is without weight
        self.mean = np.zeros(FEATURES, np.float32)
        self.mean = (sum(block.sum(axis=0, dtype=float) for _, block in self.blocks()) / max(1, len(self))).astype(np.float32)

    def __len__(self):
        return len(self.marks)

    def blocks(self):
        """(first row, weighted features less their mean) of a block."""
        for a in range(0, len(self), BLOCK):
            b = min(a + BLOCK, len(self))
            part = slice(self.first[a], self.first[b])
            rows = np.zeros((b - a, FEATURES), np.float32)
            rows[np.repeat(np.arange(b - a), np.diff(self.first[a: b + 1])), self.places[part]] = self.values[part]
            yield a, weighted(rows, self.rarity) - self.mean

    def times(self, right: np.ndarray) -> np.ndarray:
        return np.concatenate([block @ right for _, block in self.blocks()])

    def transposed_times(self, right: np.ndarray) -> np.ndarray:
        return sum(block.T @ right[a: a + len(block)] for a, block in self.blocks())


def sample_of(labels: DataFrame, rows: int, id: str, label: str) -> DataFrame:
    """At most ``rows`` labelled ids of the training fold, those of the smallest hash, half of them at most from each label; ids labelled twice
    count as the lower label."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id))
    known = known.groupBy(F.col(id).alias("__id")).agg(F.min(label).cast("int").alias("__label"))
    return known.where("__label = 0").orderBy(F.xxhash64("__id"), "__id").limit(rows // 2).union(
        known.where("__label = 1").orderBy(F.xxhash64("__id"), "__id").limit(rows // 2))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, width: int = 48, id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """A space and the labelled vectors in it: ``rarity`` (of each feature, the log of the inverse share of labelled texts that have it), ``mean``, ``basis`` (features x width), ``vectors`` (unit rows), ``labels``, ``weights`` of the labels (their shares in
    training over those in the sample), ``prior``.

    Fitted on a sample of at most ``rows`` labelled documents of the training fold. Rows of one id count as one text, that of the smallest hash, so the bound holds however often an
    id is repeated. The driver gets the features that are not zero, at most ``6 * rows * FEATURES`` bytes and about a tenth of that for common texts. Shares of labels are counted
    over all labels of the fold.
    """
    sample = sample_of(labels, rows, id, label)
    shares = {int(r[0]): r[1] for r in labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id)).groupBy(label).count().collect()}
    found = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sample), "__id")   # ids: at most ``rows``
    found = found.groupBy("__id").agg(F.first("__label").alias("__label"), F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    sparse = "order bigint, label int, places binary, values binary"
    table = found.select(F.xxhash64("__id").alias("order"), "__label", "__text").mapInArrow(feature_rows, sparse).toArrow()
    prior = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    if not table.num_rows:
        return {"rarity": np.ones(FEATURES, np.float32), "mean": np.zeros(FEATURES, np.float32), "basis": np.zeros((FEATURES, 1), np.float32), "vectors": np.zeros((0, 1), np.float32),
                "labels": np.zeros(0), "weights": np.zeros(0), "prior": prior}
    matrix = Sample(table)
    del table
    width = min(width, len(matrix))
    start = matrix.times(np.random.default_rng(5).standard_normal((FEATURES, width + 8)).astype(np.float32))
    for _ in range(3):   # subspace iteration
        start = matrix.times(matrix.transposed_times(np.linalg.qr(start)[0]))
    small = matrix.transposed_times(np.linalg.qr(start)[0]).T
    basis = np.linalg.svd(small, full_matrices=False)[2][:width].T.astype(np.float32)
    marks = matrix.marks
    weights = np.array([shares[int(m)] / max(1, (marks == m).sum()) for m in marks])
    return {"rarity": matrix.rarity, "mean": matrix.mean, "basis": basis, "vectors": units(matrix.times(basis)), "labels": marks.astype(float), "weights": weights / weights.mean(), "prior": prior}


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def votes(model: dict, rows: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
    """Shares of label 1 among the nearest labelled vectors, weighted by similarity."""
    if not len(model["labels"]):
        return np.full(len(rows), model["prior"])
    some = rows.any(axis=1)
    cosine = units((weighted(rows, model["rarity"]) - model["mean"]) @ model["basis"]) @ model["vectors"].T
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.exp(sharpness * (np.take_along_axis(cosine, near, axis=1) - 1)).astype(float) * model["weights"][near]
    share = (weight * model["labels"][near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(np.where(some, share, model["prior"]), 0, 1)


def scorer(model, text: int, neighbours: int, sharpness: float, added: str):
    def run(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = texts_of(batch.column(text))
            scores = np.zeros(batch.num_rows)
            for first, last in slices(offsets):
                for a in range(first, last, BLOCK):
                    b = min(a + BLOCK, last)
                    scores[a:b] = votes(model.value, features(data, offsets[a: b + 1], powers), neighbours, sharpness)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, added])
            give_back()
    return run


def score_quality(docs: DataFrame, labels: DataFrame, neighbours: int = 25, sharpness: float = 12.0, id: str = "doc_id", text: str = "text",
                  label: str = "quality", rows: int = 3000, width: int = 48, prefix: str = "__") -> DataFrame:
    """The columns of ``docs`` and ``__score``: how likely quality is 1, from 0 to 1.

    Every text is placed in the latent space that ``fit`` finds in a bounded sample of labelled documents (words, pairs of words, runs of letters and shapes, weighted by rarity), and its exact cosines with all
    labelled vectors are taken block by block; the nearest ``neighbours`` vote with weights that fall with distance. Labelled vectors and
    space are broadcast; their size is bounded by ``rows`` and ``width``. Documents aren't moved.

    Ids of the evaluation fold are never learned from, and nothing but the text is an input of a score. Null and empty texts, and all texts if there are no
    labels, get the share of label 1 (0.5 without labels). Very long texts are scored whole, a text a slice; an empty table gives no rows. Which of equally near
    vectors at the edge of the nearest vote is not defined, but the same in each run. Repeated rows are kept. ``prefix`` begins the name of the new column; a column of ``docs`` with that name is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows, width, id, text, label))
    docs = docs.drop(prefix + "score")
    schema = ", ".join(f"`{n}` {k}" for n, k in [*docs.dtypes, (prefix + "score", "double")])
    return docs.mapInArrow(scorer(model, docs.columns.index(text), neighbours, sharpness, prefix + "score"), schema)
