"""Repair of conversations whose roles or turns are out of order, by generalised LR parsing of their roles with weighted edits."""

import hashlib
import re
import zlib
from functools import wraps

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.storage import materialize

RULES = (("C", ""), ("C", "sP"), ("C", "P"), ("P", "ua"), ("P", "Pua"))   # C: a conversation, P: its pairs of turns
END = "$"
ROLES = {"u": "user", "a": "assistant"}
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT = 1 << 14   # rows of a conversation that are parsed as one piece
BYTES = 8 << 20     # of texts that a task holds before it passes rows on
FAULTS = " bdt"     # none, blank, duplicate, truncated
EDIT = r"(?:I[ua])*(?:K|D|R[ua])"
SPACE = " \t\n\x0b\x0c\r"


KEPT = 1 << 14      # results that a function remembers


def remembered(function):
    """Results by arguments, in a plain table that travels to the executors with the function."""
    known: dict = {}

    @wraps(function)
    def call(*arguments):
        if arguments not in known:
            result = function(*arguments)
            if len(known) >= KEPT:
                known.clear()
            known[arguments] = result
        return known[arguments]
    return call


# ---- the automaton of the role grammar

@remembered
def closed(items: frozenset) -> frozenset:
    """Items (rule, dot) with those of every symbol that may come next; rule -1 is the start."""
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        body = "C" if rule < 0 else RULES[rule][1]
        for i, (head, _) in enumerate(RULES):
            if body[dot: dot + 1] == head and (i, 0) not in found:
                found.add((i, 0))
                todo.append((i, 0))
    return frozenset(found)


@remembered
def goto(state: frozenset, symbol: str) -> frozenset:
    return closed(frozenset((r, d + 1) for r, d in state if ("C" if r < 0 else RULES[r][1])[d: d + 1] == symbol))


START = closed(frozenset([(-1, 0)]))


@remembered
def followers(head: str) -> frozenset:
    """Terminals that may follow ``head``. Only the first symbol after it counts: no symbol inside a rule can be empty."""
    found = {END} if head == "C" else set()
    for left, body in RULES:
        for i, symbol in enumerate(body):
            if symbol == head:
                found |= followers(left) if i + 1 == len(body) and left != head else set(body[i + 1: i + 2])
    return frozenset(found)


@remembered
def after(stack: tuple, symbol: str) -> tuple | None:
    """A stack of states after all reductions that ``symbol`` allows and the symbol's shift; None if it can't come next. ``END`` gives the stack that accepts."""
    while True:
        if goto(stack[-1], symbol):
            return (*stack, goto(stack[-1], symbol))
        if symbol == END and (-1, 1) in stack[-1]:
            return stack
        rules = [RULES[r] for r, d in stack[-1] if r >= 0 and d == len(RULES[r][1]) and symbol in followers(RULES[r][0])]
        if not rules:
            return None
        head, body = rules[0]   # the grammar has at most one reduction for a symbol
        stack = stack[: len(stack) - len(body)]
        stack = (*stack, goto(stack[-1], head))


def tops() -> list[tuple]:
    """One stack for each state that can be on top between two rows; the start comes first."""
    found, todo = {START: (START,)}, [(START,)]
    while todo:
        stack = todo.pop()
        for symbol in "sua":
            more = after(stack, symbol)
            if more and more[-1] not in found:
                found[more[-1]] = more
                todo.append(more)
    return list(found.values())


TOPS = tops()
NUMBER = {stack[-1]: i for i, stack in enumerate(TOPS)}

# ---- frontiers: the tops of the graph-structured stack between two rows, each (stack, cost above the least, rank of its audit). Stacks are
# paths of shared states. Stacks with equal tops take the same continuations in this grammar, so they merge into the one of least (cost, audit). Audits of a
# frontier are never prefixes of each other, as inserts are only made before a row or at the end, so their order is their rank's, then that of what is added.


def better(found: dict, stack: tuple, value: tuple) -> bool:
    """Keep ``value`` (cost, rank, letters, from, edits) for the top of ``stack`` if it is the least so far."""
    if stack[-1] in found and found[stack[-1]][1][:3] <= value[:3]:
        return False
    found[stack[-1]] = (stack, value)
    return True


def inserted(frontier: tuple) -> dict:
    """All tops that a frontier reaches by inserts."""
    found: dict = {}
    todo = [(stack, (cost, rank, "", i, "")) for i, (stack, cost, rank) in enumerate(frontier)]
    while todo:
        stack, value = todo.pop(0)
        if better(found, stack, value):
            cost, rank, letters, i, edits = value
            todo += [(after(stack, c), (cost + INSERT, rank, letters + "I", i, edits + "I" + c)) for c in ROLES if after(stack, c)]
    return found


@remembered
def step(frontier: tuple, initial: str, fault: str) -> tuple[tuple, int, tuple]:
    """The frontier after one row, the least cost that is added, and for each new top (place of the old one, edits)."""
    found: dict = {}
    for stack, (cost, rank, letters, i, edits) in inserted(frontier).values():
        better(found, stack, (cost + DELETE, rank, letters + "D", i, edits + "D"))
        if fault in " t":
            price = cost + (TRUNCATED if fault == "t" else 0)
            if initial and initial in "sua" and after(stack, initial):
                better(found, after(stack, initial), (price, rank, letters + "K", i, edits + "K"))
            for c in ROLES:
                if after(stack, c):
                    better(found, after(stack, c), (price + RETYPE, rank, letters + "R", i, edits + "R" + c))
    order = sorted(found.values(), key=lambda x: x[1][1:3])
    least = min(x[1][0] for x in order)
    return (tuple((stack, value[0] - least, rank) for rank, (stack, value) in enumerate(order)), least, tuple((x[1][3], x[1][4]) for x in order))


def finished(frontier: tuple) -> tuple[int, int, str]:
    """(place in the frontier, cost, edits) of the least way to a whole conversation."""
    done = [value for stack, value in inserted(frontier).values() if after(stack, END)]
    cost, _, _, i, edits = min(done)
    return i, cost, edits


def walked(codes: list[tuple[str, str]], entry: int) -> list[tuple[int, int, str]]:
    """Ways through rows (initial, fault) from a top, as (top, cost, edits), by their audits' order."""
    frontier, total, links = ((TOPS[entry], 0, 0),), 0, []
    for initial, fault in codes:
        frontier, least, back = step(frontier, initial, fault)
        total += least
        links.append(back)
    out = []
    for i, (stack, cost, _) in enumerate(frontier):
        parts, at = [], i
        for back in reversed(links):
            at, edits = back[at]
            parts.append(edits)
        out.append((NUMBER[stack[-1]], total + cost, "".join(reversed(parts))))
    return out


def audit_of(edits: str) -> str:
    return re.sub("[ua]", "", edits)


def parsed(segments) -> tuple[int, list[str], str]:
    """Cost, edits of each segment and final inserts of a conversation. A segment is a list of ways (entry, exit, cost, edits)."""
    ways = [(0, 0, [])]   # (top, cost, edits), in the order of their audits
    for segment in segments:
        best: dict = {}
        for rank, (top, cost, before) in enumerate(ways):
            for entry, leave, more, edits in segment:
                value = (cost + more, rank, audit_of(edits), edits)
                if entry == top and (leave not in best or value[:3] < best[leave][0][:3]):
                    best[leave] = (value, before)
        order = sorted(best.items(), key=lambda x: x[1][0][1:3])
        ways = [(leave, value[0], [*before, value[3]]) for leave, (value, before) in order]
    i, cost, edits = finished(tuple((TOPS[top], cost, rank) for rank, (top, cost, _) in enumerate(ways)))
    return cost, ways[i][2], edits


# ---- the job

def edited(edit: str, role: str | None, text: str | None):
    """Rows that the edits of one row leave: its inserts, and the row unless it is deleted."""
    for c in re.findall("I([ua])", edit):
        yield ROLES[c], ""
    kind = re.sub("I[ua]", "", edit)
    if kind and kind != "D":
        yield (role if kind == "K" else ROLES[kind[1]]), text


TALLY = ("n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, turns bigint, low bigint, high bigint, "
         "whole boolean, cost bigint, edits string, ways array<struct<entry: int, leave: int, cost: bigint, edits: binary>>")
PARSED = f"conv bigint, segment bigint, at bigint, sub int, role string, text string, pending boolean, tally struct<{TALLY}>"
DIGESTS = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])
COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")
LEGAL = ("su", "ua", "au")


def merged(a: dict, b: dict) -> dict:
    """Tallies of two neighbouring segments."""
    out = {k: a[k] + b[k] for k in COUNTS}
    out["illegal"] += (a["last"] + b["first"]) not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def parser(kinds: pa.Schema):
    """Sorted rows to repaired rows and tallies. A conversation that lies inside the task's rows is repaired at once; the rows of its first and
    last one, whose others may be in other tasks, and of conversations of more than ``SEGMENT`` rows are pending, with the ways through each of their segments."""
    def run(batches):
        part, serial = TaskContext.get().partitionId() << 32, 0
        out: list[tuple] = []
        held, key, before = [], None, None
        is_open, size, started = True, 0, False

        def batch():
            nonlocal out, size
            columns = list(zip(*out))
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types)], schema=kinds)

        def close(whole: bool):
            nonlocal held, serial
            codes = [(r[2][:1], r[4]) for r in held]
            turns = [r[1] for r in held if r[1] is not None]
            initials = [c[0] for c in codes]
            tally = {"n_rows": len(held)} | {k: sum(c[1] == k[0] for c in codes) for k in ("blank", "duplicate", "truncated")}
            tally |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
                      "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None), "whole": whole, "cost": None, "edits": None, "ways": None}
            edits = [None] * len(held)
            if whole:
                tally["cost"], (made,), tail = parsed([[(0, *way) for way in walked(codes, 0)]])
                edits, tally["edits"] = re.findall(EDIT, made), made + tail
            else:
                tally["ways"] = [{"entry": e, "leave": leave, "cost": cost, "edits": zlib.compress(way.encode())} for e in range(len(TOPS)) for leave, cost, way in walked(codes, e)]
            conv, segment, serial = held[0][0], part + serial, serial + 1
            for at, (row, edit) in enumerate(zip(held, edits)):
                made = edited(edit, row[2], row[3]) if whole else [(row[2], row[3])]
                out.extend((conv, segment, at, sub, role, text, not whole, None) for sub, (role, text) in enumerate(made))
            if whole:
                out.extend((conv, segment, len(held), sub, role, text, False, None) for sub, (role, text) in enumerate(edited(tail, None, None)))
            out.append((conv, segment, None, None, None, None, None, tally))
            held = []

        for incoming in batches:
            for conv, turn, role, text, fault, digest, again in zip(*(c.to_pylist() for c in incoming.columns)):
                if not started or conv != key:
                    if held:
                        close(not is_open)
                    is_open, key, before = not started, conv, None
                    started = True
                elif len(held) == SEGMENT:
                    is_open = True
                    close(False)
                same = before == (turn, digest)
                before = (turn, digest)
                held.append((conv, turn, role, text, fault if fault == "b" else "d" if again or same else fault))
                size += len(text) + 64
                if size > BYTES and out:
                    yield batch()
        if held:
            close(False)
        if out:
            yield batch()
    return run


def combine(table: pa.Table) -> pa.Table:
    """The tallies of one conversation's segments to one row for the conversation and one of edits for each segment."""
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    whole = rows[0]
    for row in rows[1:]:
        whole = merged(whole, row)
    cost, edits, tail = parsed([(w["entry"], w["leave"], w["cost"], zlib.decompress(w["edits"]).decode()) for w in row["ways"]] for row in rows)
    out = [{"conv": rows[0]["conv"], "cost": cost, "edits": "".join(edits) + tail, "low": whole["low"], "high": whole["high"]} | {k: whole[k] for k in COUNTS}]
    out += [{"conv": r["conv"], "segment": r["segment"], "edits": e + (tail if r is rows[-1] else "")} for r, e in zip(rows, edits)]
    names = ["conv", "segment", *COUNTS, "low", "high", "cost", "edits"]
    return pa.table({n: pa.array([r.get(n) for r in out], pa.string() if n == "edits" else pa.int64()) for n in names})


COMBINED = "conv bigint, segment bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", low bigint, high bigint, cost bigint, edits string"


def applied(batches):
    """Pending rows with their edits (conv, segment, at, edit, role, text) to repaired rows."""
    for batch in batches:
        rows = [(conv, segment, at, sub, *made) for conv, segment, at, edit, role, text in zip(*(c.to_pylist() for c in batch.columns))
                for sub, made in enumerate(edited(edit, role, text))]
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "segment", "at", "sub", "role", "text"])


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A report with one row per conversation that has rows (``conv_id``, ``n_rows``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``) and
    the repaired rows (``conv_id``, ``segment``, ``at``, ``sub``, ``role``, ``text``; in the order of the middle three within a conversation).

    Rows are taken by turn (null first), then role, then digest of role and text; null roles and texts count as one space. The first fault of a row counts: blank (white space
    only), duplicate (role and text seen earlier), truncated (its last other character is not ``.``, ``!`` or ``?``). A repaired conversation's role initials are
    ``(s?(ua)+)?``. Keeping a row costs nothing, giving it the role user or assistant 1, deleting it 2 (a must for blank and duplicate rows), inserting an empty row of user or assistant
    5, and a truncated row that stays 5. The cheapest edits are found by a generalised LR parser: the tops of its graph-structured stack after each row are all states that some
    edits lead to, and equal tops merge into the one of the least (cost, audit). ``audit`` holds the edits' initials in order; ties go to the ASCII-least.
    ``gaps`` is the greatest turn less the smallest, plus one, less the distinct ones (0 without turns); ``illegal`` counts neighbours whose initials aren't su, ua or au.

    A conversation may be most of all rows: rows are range-sorted by (conversation, turn, role, digest), so it is spread over many tasks; each parses its segments from every state, and
    only the ways through segments (one letter a row, compressed) meet in one task. The audit of a conversation is one value all the same. Duplicates are found by the
    first turn of each (conversation, role, text), not in a list of what was seen. Rows with a null conversation are one conversation. Repeated rows are duplicates. Texts of any length are
    whole; no rows, no conversations. Other columns are ignored. Role and text are compared by their 128-bit digests.
    """
    rows = rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    fault = F.when(F.length(trimmed) == 0, "b").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), " ").otherwise("t")
    rows = rows.select("*", fault.alias("fault"), F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"))
    early = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("early")   # a null turn comes first
    first = rows.groupBy("conv", "digest").agg(early, F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select(F.col("conv").alias("c"), F.col("digest").alias("d"), F.col("early.turn").alias("early")))
    found = rows.join(first, rows["conv"].eqNullSafe(first["c"]) & (rows["digest"] == first["d"]), "left")
    again = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("early"))
    found = materialize(found.select("conv", "turn", "role", "text", "fault", "digest", again.alias("again")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    out = found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(parser(arrow_schema()), PARSED)
    out = materialize(out)
    tallies = out.where("tally is not null").select("conv", "segment", "tally.*")
    joined = materialize(tallies.where("not whole").groupBy("conv").applyInArrow(combine, COMBINED))
    columns = ["conv", *COUNTS, "low", "high", "cost", "edits"]
    report = tallies.where("whole").select(*columns).union(joined.where("segment is null").select(*columns))
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    report = report.select(F.col("conv").alias("conv_id"), "n_rows", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
                           F.regexp_replace("edits", "[ua]", "").alias("audit"))
    edits = joined.where("segment is not null").select("segment", F.posexplode(F.expr(f"regexp_extract_all(concat(edits, ''), '{EDIT}|(?:I[ua])+$', 0)")).alias("at", "edit"))
    pending = out.where("pending").select("conv", "segment", "at", "role", "text")
    # inserts at the end of a conversation follow its last row
    ends = joined.where("segment is not null").select("conv", "segment")
    pending = edits.join(pending, ["segment", "at"], "left").join(ends.withColumnRenamed("conv", "own"), "segment")
    pending = pending.select(F.col("own").alias("conv"), "segment", F.col("at").cast("bigint").alias("at"), "edit", "role", "text")
    repaired = out.where("not pending").select("conv", "segment", "at", "sub", "role", "text").union(
        pending.mapInArrow(applied, "conv bigint, segment bigint, at bigint, sub int, role string, text string"))
    return report, repaired.withColumnRenamed("conv", "conv_id")


def digests(batches):
    """Rows (conversation, role, text), sorted, to one SHA-256 for each conversation in the task, of its ``role:text`` lines. One line is in memory at a time."""
    hashed, key = None, None
    done: list[tuple] = []
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if hashed is None or conv != key:
                if hashed is not None:
                    done.append((key, hashed.hexdigest()))
                hashed, key = hashlib.sha256(f"{role}:{text}".encode()), conv
            else:
                hashed.update(f"\n{role}:{text}".encode())
        if len(done) > SEGMENT:
            yield pa.RecordBatch.from_pylist([{"conv_id": k, "sha256": v} for k, v in done], DIGESTS)
            done = []
    if hashed is not None:
        done.append((key, hashed.hexdigest()))
    if done:
        yield pa.RecordBatch.from_pylist([{"conv_id": k, "sha256": v} for k, v in done], DIGESTS)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and ``sha256`` of the repaired conversation. A SHA-256 is a chain, so the lines of one conversation pass through one task, as a stream."""
    lines = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "at", "sub").select("conv_id", "role", "text")
    return lines.mapInArrow(digests, "conv_id bigint, sha256 string")


def arrow_schema() -> pa.Schema:
    """``PARSED`` as Arrow."""
    way = pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("edits", pa.binary())])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    plain = [field.split(" ") for field in TALLY[: TALLY.index(", ways")].split(", ")]
    tally = pa.struct([*((name, kinds[kind]) for name, kind in plain), ("ways", pa.list_(way))])
    return pa.schema([("conv", pa.int64()), ("segment", pa.int64()), ("at", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("text", pa.string()),
                      ("pending", pa.bool_()), ("tally", tally)])
