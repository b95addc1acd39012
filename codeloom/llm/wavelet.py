"""Token ids in files of wavelet matrices."""

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm.storage import shared_folder
from codeloom.llm.tokens import encoder_of

SHARD_TOKENS = 1 << 21   # a shard ends with the document that reaches this
PIECE = 1 << 13          # bytes of a plane that are compressed together, with a stored rank
MAGIC = b"WVMX0003"
HEADER = "<8sQQI"   # magic, tokens, documents, planes


class Plane:
    """The bits of a plane in pieces of ``PIECE`` bytes that are compressed one by one, with the ones before each piece: a rank, a bit or a place inflates one piece.
    ``inflated`` counts the bytes that were."""

    def __init__(self, size: int, before: np.ndarray, pieces: list[bytes]):
        self.size, self.before, self.pieces, self.inflated = size, before, pieces, 0
        self.ones = int(before[-1])
        self.zeros = size - self.ones

    @classmethod
    def pack(cls, bits: np.ndarray) -> "Plane":
        packed = np.packbits(bits, bitorder="little")
        starts = np.arange(0, len(packed), PIECE)
        counts = np.add.reduceat(np.bitwise_count(packed), starts, dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        return cls(len(bits), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), [pa.compress(packed[a: a + PIECE], codec="zstd", asbytes=True) for a in starts])

    def piece(self, k: int) -> np.ndarray:
        plain = min(PIECE, -(-self.size // 8) - k * PIECE)
        self.inflated += plain
        return np.frombuffer(pa.decompress(self.pieces[k], plain, codec="zstd", asbytes=True), np.uint8)

    def bits(self) -> np.ndarray:
        data = np.concatenate([self.piece(k) for k in range(len(self.pieces))]) if self.pieces else np.zeros(0, np.uint8)
        return np.unpackbits(data, count=self.size, bitorder="little").view(bool)

    def rank(self, i: int) -> tuple[int, int]:
        """Ones before place ``i``, and the bit there (0 at the end)."""
        k, at = divmod(i, PIECE * 8)
        if at == 0 and i >= self.size:
            return self.ones, 0
        data = self.piece(k)
        byte = int(data[at // 8]) if at // 8 < len(data) else 0
        return int(self.before[k]) + int(np.bitwise_count(data[: at // 8]).sum()) + (byte & ((1 << (at % 8)) - 1)).bit_count(), byte >> (at % 8) & 1

    def places(self, nth: np.ndarray, bit: int) -> np.ndarray:
        """Places of the ``nth`` (from 0, rising) bits of a kind; each piece that holds any is inflated once."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * PIECE * 8, self.size) - self.before
        own = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), np.int64)
        for k in np.unique(own):
            bits = np.unpackbits(self.piece(int(k)), bitorder="little")[: self.size - int(k) * PIECE * 8]
            out[own == k] = int(k) * PIECE * 8 + np.flatnonzero(bits == bit)[nth[own == k] - before[k]]
        return out


class WaveletMatrix:
    """Ids of a shard as bit planes, from the highest bit down; below each plane the zeros of all ids come first, then the ones,
    both in order. An access, a count or an occurrence takes a few steps per plane, each in one piece of it. What the planes hold of an
    id is its place in ``alphabet``, the shard's distinct ids by falling frequency: there are fewer planes, and the high ones are mostly zeros."""

    def __init__(self, size: int, planes: list[Plane], alphabet: np.ndarray):
        self.size, self.planes, self.alphabet = size, planes, alphabet

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
        alphabet = np.flatnonzero(counts)
        alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")].astype(np.uint32)
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        codes = np.zeros(len(counts), kind)
        codes[alphabet] = np.arange(len(alphabet))
        row, planes = codes[ids], []
        for bit in range(max(1, (len(alphabet) - 1).bit_length()) - 1 if len(alphabet) else -1, -1, -1):
            ones = (row & kind(1 << bit)).astype(bool)
            planes.append(Plane.pack(ones))
            row = np.concatenate([np.compress(~ones, row), np.compress(ones, row)])
        return cls(len(ids), planes, alphabet)

    @property
    def inflated(self) -> int:
        return sum(p.inflated for p in self.planes)

    def ids(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        row = np.zeros(self.size, kind)
        for i, plane in enumerate(reversed(self.planes)):
            ones, above = plane.bits(), np.empty(self.size, kind)
            above[np.flatnonzero(~ones)] = row[:plane.zeros]
            above[np.flatnonzero(ones)] = row[plane.zeros:] | kind(1 << i)
            row = above
        return self.alphabet[row]

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for plane in self.planes:
            ones, bit = plane.rank(i)
            i = plane.zeros + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _code(self, value: int) -> int | None:
        found = np.flatnonzero(self.alphabet == value)
        return int(found[0]) if len(found) else None

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id before place ``end``."""
        code = self._code(value)
        if code is None:
            return 0
        first, last = self._range(code, 0, end)
        return last - first

    def _range(self, code: int, first: int, last: int) -> tuple[int, int]:
        for level, plane in enumerate(self.planes):
            a, b = plane.rank(first)[0], plane.rank(last)[0]
            if code >> (len(self.planes) - 1 - level) & 1:
                first, last = plane.zeros + a, plane.zeros + b
            else:
                first, last = first - a, last - b
        return first, last

    def occurrences(self, value: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences from the ``first`` (from 0) to before the ``last`` of an id, in order; to the end without ``last``."""
        code = self._code(value)
        if code is None:
            return np.zeros(0, np.int64)
        low, high = self._range(code, 0, self.size)
        at = np.arange(low, high)[first:last]
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            at = self.planes[level].places(at - self.planes[level].zeros if bit else at, bit)
        return at

    def select(self, value: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of an id; IndexError beyond the last."""
        found = self.occurrences(value, nth, nth + 1) if nth >= 0 else ()
        if not len(found):
            raise IndexError(nth)
        return int(found[0])


def to_bytes(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> bytes:
    """One shard: header; its documents' ids, lengths and null marks and its alphabet, each part compressed; then each plane's ranks at its pieces, the pieces' sizes and the
    pieces."""
    matrix = WaveletMatrix.build(ids)
    out = [struct.pack(HEADER, MAGIC, len(ids), len(docs), len(matrix.planes))]
    for part in (docs.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), np.packbits(valid).tobytes(), matrix.alphabet.astype("<u4").tobytes()):
        packed = pa.compress(part, codec="zstd", asbytes=True)
        out += [struct.pack("<QQ", len(part), len(packed)), packed]
    for plane in matrix.planes:
        out += [plane.before.astype("<i8").tobytes(), np.array([len(p) for p in plane.pieces], "<u4").tobytes(), *plane.pieces]
    return b"".join(out)


def from_bytes(blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's matrix, and its documents' ids, lengths and whether the id is not null. The planes stay compressed."""
    magic, size, rows, planes = struct.unpack_from(HEADER, blob)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at, parts = struct.calcsize(HEADER), []
    for _ in range(4):
        plain, packed = struct.unpack_from("<QQ", blob, at)
        at += 16
        parts.append(np.frombuffer(pa.decompress(blob[at: at + packed], plain, codec="zstd", asbytes=True), np.uint8) if plain else np.zeros(0, np.uint8))
        at += packed
    count, found = -(-size // (8 * PIECE)), []
    for _ in range(planes):
        before = np.frombuffer(blob, "<i8", count + 1, at)
        sizes = np.frombuffer(blob, "<u4", count, at + 8 * (count + 1))
        starts = at + 8 * (count + 1) + 4 * count + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        found.append(Plane(size, before, [blob[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]))
        at = int(starts[-1])
    return WaveletMatrix(size, found, parts[3].view("<u4")), parts[0].view("<i8"), parts[1].view("<i8"), np.unpackbits(parts[2], count=rows).astype(bool)


def writer(content, end_id: int, shard_tokens: int):
    def run(batches):
        encoder = encoder_of(content)
        part, number, before, parts, held = TaskContext.get().partitionId(), 0, 0, [], 0

        def shard():
            docs = pa.chunked_array([p[0] for p in parts], pa.int64()).combine_chunks()
            lengths = np.concatenate([p[2] for p in parts])
            ids = np.concatenate([p[1] for p in parts])
            blob = to_bytes(ids, docs.fill_null(0).to_numpy(zero_copy_only=False), lengths, docs.is_valid().to_numpy(zero_copy_only=False))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
                                               pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
                                              ["part", "number", "before", "n_docs", "n_tokens", "content"])

        for batch in batches:
            for first, flat, ends in encoder.encode(batch.column(1)):
                a, rows = 0, len(ends) - 1
                while a < rows:
                    b = int(np.searchsorted(ends + np.arange(rows + 1), ends[a] + a + shard_tokens - held))
                    b = min(max(b, a + 1), rows)
                    lengths = np.diff(ends[a: b + 1]) + 1
                    ids = np.full(int(lengths.sum()), end_id, np.uint32)
                    inside = np.ones(len(ids), bool)
                    inside[np.cumsum(lengths) - 1] = False
                    ids[inside] = flat[ends[a]: ends[b]]
                    parts.append((batch.column(0).slice(first + a, b - a), ids, lengths))
                    held += len(ids)
                    a = b
                    if held >= shard_tokens:
                        yield shard()
                        parts, held, number, before = [], 0, number + 1, before + held
        if parts:
            yield shard()
    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of id, as one file per shard.

    Texts are dealt out once, by ranges of (id, text's hash), so a repeated id does not make a range that can't be split; nulls come last. A file is a table of
    one row: the shard's place (``part``, ``number``, and ``before``, the ids of its part before it), its numbers of documents and ids, and the wavelet matrix itself. Spark's commit
    makes the files of a lost task whole or absent. Null is the empty text; very long texts are encoded whole; an empty table gives no shard. Rows equal in id and text follow each other
    in any order. A shard holds about ``shard_tokens`` ids, more only if its last document is longer.
    """
    content = docs.sparkSession.sparkContext.broadcast(tokenizer)
    keyed = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    shards = keyed.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(
        writer(content, end_id, shard_tokens), "part int, number int, before bigint, n_docs bigint, n_tokens bigint, content binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(folder)


def reader(batches):
    for batch in batches:
        for base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            matrix, docs, lengths, valid = from_bytes(blob)
            data = matrix.ids().astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for a in range(0, len(docs), 1024):
                b = min(a + 1024, len(docs))
                bounds = pa.py_buffer(((ends[a: b + 1] - ends[a]) * 4).astype(np.int32).tobytes())
                ids = pa.Array.from_buffers(pa.binary(), b - a, [None, bounds, pa.py_buffer(data[ends[a]: ends[b]])])
                yield pa.RecordBatch.from_arrays([pa.array(docs[a:b], mask=~valid[a:b]), pa.array(base + ends[a:b]), ids], ["doc_id", "start", "ids"])


def with_base(shards: DataFrame) -> DataFrame:
    """Adds ``base``: the ids of all shards before. Totals of parts, one row for each task that wrote, go through the driver to all tasks;
    the shards themselves stay where they are read."""
    totals = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    at, rows = 0, []
    for part, total in totals:
        rows.append((part, at))
        at += total
    bases = F.broadcast(shards.sparkSession.createDataFrame(rows, "part int, start bigint"))
    return shards.join(bases, "part").withColumn("base", F.col("before") + F.col("start"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (little-endian unsigned 32-bit)."""
    shards = with_base(spark.read.parquet(folder))
    return shards.select("base", "content").mapInArrow(reader, "doc_id bigint, start bigint, ids binary")


def occurrences(spark: SparkSession, folder: str, value: int, places: bool = False) -> DataFrame:
    """How often an id occurs, by shard (``part``, ``number``, ``n``), or with ``places`` one row per occurrence (``place`` among the ids of all files), by
    rank and select on the files, without decoding their ids."""
    def run(batches):
        for batch in batches:
            for part, number, base, blob in zip(*(c.to_pylist() for c in batch.columns)):
                matrix = from_bytes(blob)[0]
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(base + matrix.occurrences(value))], ["place"])
                else:
                    n = matrix.rank(value, matrix.size)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64())], ["part", "number", "n"])

    rows = with_base(spark.read.parquet(folder)).select("part", "number", "base", "content")
    return rows.mapInArrow(run, "place bigint" if places else "part int, number int, n bigint")


def fresh_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "token-ids")
