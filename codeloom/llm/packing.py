"""Hierarchical packing of token ids into sequences of several lengths."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.tokens import encoder_of

POOL = 4096        # documents that a task packs together
STEP = 32          # sequences of a step group
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, "
          "step_group bigint")


class Shelf:
    """Pieces of documents by length; the longest one that fits is found by a bit mask."""

    def __init__(self, most: int):
        self.by_length: list[list] = [[] for _ in range(most + 1)]
        self.mask = 0

    def put(self, piece: tuple) -> None:
        self.by_length[piece[2]].append(piece)
        self.mask |= 1 << piece[2]

    def take(self, most: int):
        """The longest piece of at most ``most`` ids, or None."""
        length = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if length < 1:
            return None
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask &= ~(1 << length)
        return piece

    def take_shortest(self):
        return self.take((self.mask & -self.mask).bit_length() - 1) if self.mask else None


def split(piece: tuple, length: int) -> tuple[tuple, tuple]:
    doc, start, size = piece
    return (doc, start, length), (doc, start + length, size - length)


def pack(pieces: list[tuple], tiers: list[int]) -> tuple[list, list]:
    """The last pieces of all tiers put into sequences of the longest one, as (tier, pieces), and what is left over, less than one of them; pieces are (document, start, length).

    Each piece opens a window, gaps are filled with the longest pieces that fit, and a gap that nothing fits is closed by cutting the shortest piece, so only the last window is not
    full.
    """
    longest = tiers[0]
    full = []
    shelves = {tier: Shelf(tier) for tier in tiers}
    for piece in pieces:
        while piece[2] >= longest:
            head, piece = split(piece, longest)
            full.append((longest, [head]))
        if piece[2]:
            shelves[min(t for t in tiers if t >= piece[2])].put(piece)
    window, room = [], longest

    def fill(piece) -> None:
        nonlocal window, room
        while piece[2] >= room:
            head, piece = split(piece, room)
            full.append((longest, [*window, head]))
            window, room = [], longest
            if not piece[2]:
                return
        window.append(piece)
        room -= piece[2]

    for i, tier in enumerate(tiers):
        while (piece := shelves[tier].take(tier)) is not None:
            fill(piece)
            # best fit, from the tier below downwards, then of this tier
            while window and (more := next((x for t in [*tiers[i + 1:], tier] if (x := shelves[t].take(min(room, t))) is not None), None)) is not None:
                fill(more)
            if window:
                cut = next((x for t in reversed(tiers) if (x := shelves[t].take_shortest()) is not None), None)
                if cut is not None:
                    fill(cut)
    return full, window


def pack_tiers(pieces: list[tuple], tiers: list[int]) -> tuple[list, list]:
    """Full sequences of all tiers as (tier, pieces), and what is left over, less than one of the longest; pieces are (document, start, length).

    Whole windows of the longest tier are cut off first. What remains of a document is routed to the shortest tier that holds it, and each tier is
    packed into windows of its own length, from the longest down: its longest piece opens a window, and the gap is filled with the longest pieces of the
    shorter tiers that fit, then of its own. Only when every piece has its window are gaps closed by cutting, in each tier by itself: its emptiest windows are
    taken apart, and their pieces go where they fit whole, or else the shortest one is cut. The last pieces of all tiers, less than a window of each, are joined by ``pack``.
    """
    longest = tiers[0]
    full, rest = [], []
    shelves = {tier: Shelf(tier) for tier in tiers}
    for piece in pieces:
        while piece[2] >= longest:
            head, piece = split(piece, longest)
            full.append((longest, [head]))
        if piece[2]:
            shelves[min(t for t in tiers if t >= piece[2])].put(piece)
    open_windows = {tier: [] for tier in tiers}   # (room, pieces)
    for i, tier in enumerate(tiers):
        while (piece := shelves[tier].take(tier)) is not None:
            window, room = [piece], tier - piece[2]
            while room and (more := next((x for t in [*tiers[i + 1:], tier] if (x := shelves[t].take(min(room, t))) is not None), None)) is not None:
                window.append(more)
                room -= more[2]
            if room:
                open_windows[tier].append((room, window))
            else:
                full.append((tier, window))
    for tier in tiers:
        waiting = sorted(open_windows[tier], key=lambda x: x[0])   # the fullest first
        loose, first, last = Shelf(tier), 0, len(waiting)
        while first < last:
            room, window = waiting[first]
            first += 1
            while room:
                piece = loose.take(room)
                if piece is None and (piece := loose.take_shortest()) is None:
                    if first == last:
                        break
                    last -= 1
                    for x in waiting[last][1]:
                        loose.put(x)
                    continue
                if piece[2] > room:
                    piece, tail = split(piece, room)
                    loose.put(tail)
                window.append(piece)
                room -= piece[2]
            if room:
                rest += window
            else:
                full.append((tier, window))
        while (piece := loose.take(tier)) is not None:
            rest.append(piece)
    more, left = pack(rest, tiers)
    return full + more, left


def powers(pieces: list[tuple]) -> list[tuple[int, list]]:
    """Cut into sequences whose lengths are powers of two, the largest first: none needs padding."""
    total, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        window, room = [], size
        while room:
            piece = pieces.pop()
            if piece[2] > room:
                piece, rest = split(piece, room)
                pieces.append(rest)
            window.append(piece)
            room -= piece[2]
        out.append((size, window))
        total -= size
    return out


def step_groups(sequences: list[tuple[int, list]], size: int) -> list[int]:
    """A group for each sequence. Work is the sum of the squared lengths of a sequence's pieces; sequences are dealt out tier by tier and by falling work,
    one to each group in a turn and the most work to the group that has least, so the groups of a pool have nearly equal work, equal numbers of sequences and
    equal shares of all tiers."""
    groups = -(-len(sequences) // size)
    work = [sum(p[2] ** 2 for p in s[1]) for s in sequences]
    order = sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -work[i]))
    out, held = [0] * len(sequences), [0] * groups
    for a in range(0, len(order), max(1, groups)):
        turn = sorted(order[a: a + groups], key=lambda i: -work[i])
        for i, group in zip(turn, sorted(range(groups), key=lambda g: held[g])):
            out[i] = group
            held[group] += work[i]
    return out


def packer(content, longest: int, tiers: list[int], end_id: int):
    def run(batches):
        encoder = encoder_of(content)
        part = TaskContext.get().partitionId() << 40
        sequences = steps = 0
        tokens, names, left = {}, {}, []   # of documents with ids that are not in a sequence yet
        serial = 0

        def rows(done):
            nonlocal sequences, steps
            groups = step_groups(done, STEP)
            columns = [[] for _ in range(9)]
            for (tier, window), group in zip(done, groups):
                at = 0
                for doc, start, length in window:
                    ids = tokens[doc]
                    row = (names[doc], start, length, ids[start: start + length].astype("<u4").tobytes(), len(ids), part + sequences, at, tier, part + steps + group)
                    for column, value in zip(columns, row):
                        column.append(value)
                    at += length
                sequences += 1
            steps += max(groups, default=-1) + 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, flat, ends in encoder.encode(batch.column(1)):
                for a in range(0, len(ends) - 1, POOL):
                    pool = []
                    for row in range(a, min(a + POOL, len(ends) - 1)):
                        tokens[serial] = np.append(flat[ends[row]: ends[row + 1]], np.uint32(end_id))
                        names[serial] = ids[first + row]
                        pool.append((serial, 0, len(tokens[serial])))
                        serial += 1
                    full, left = pack_tiers([*left, *pool], tiers)
                    if full:
                        yield rows(full)
                    keep = {p[0] for p in left}
                    tokens, names = {k: tokens[k] for k in keep}, {k: names[k] for k in keep}
        yield rows(powers(left))
    return run


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 1024, shorter: tuple[int, ...] = (512, 256, 128), end_id: int = 0,
                   id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, ``tier`` (the sequence's length) and ``step_group``.

    A document is its ids and ``end_id``; ``longest`` and the ``shorter`` tiers are powers of two. All sequences of a task are full windows of their tier but the
    last ids, which are cut into sequences of powers of two: nothing is padded. Tasks pack what they read and move nothing; a task holds one pool
    of documents, and a repeated task gives the same sequences under the same ids (the task's number and a running number).

    Null is the empty text, which is its end id alone. A null id stays null; repeated rows are documents of their own. Other columns are ignored. Very long texts are encoded
    whole and cut into windows of the longest tier; an empty table gives no rows. Pieces of one length are interchangeable: the one that came last goes first.
    """
    content = docs.sparkSession.sparkContext.broadcast(tokenizer)
    tiers = sorted({longest, *shorter}, reverse=True)
    return docs.select(F.col(id).cast("bigint"), text).mapInArrow(packer(content, longest, tiers, end_id), SCHEMA)
