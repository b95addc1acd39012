"""Statements of brace-language files: tokens with their bracket contexts, neighbours and calls.

Spark cuts the text into tokens and deals the files to tasks. What follows is order alone (running sums, the last opener
of a level, the token before and after), so it runs over the tokens of many files at once as numpy arrays, without a row
per token. Whatever asks for the text of a token is asked once for each distinct one.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codeloom.sources import grammar as G

TOKENS = 1 << 18   # tokens that are placed at a time; a larger file is placed alone

KINDS = ("space", "comment", "string", "name", "number", "sign")
SPACE, COMMENT, STRING, NAME, NUMBER, SIGN = range(len(KINDS))
ITEM = "pos int, tok string, kind string, start_byte int, end_byte int, start_line int, end_line int, pair_end int, pair_line int"
CALL = "spelling string, role string, start_byte int, end_byte int, start_line int, end_line int, upto int, pos int"
STATEMENT = f"path string, language string, ctx int, stmt bigint, items array<struct<{ITEM}>>, calls array<struct<{CALL}>>, comments array<string>, shape string"


def statements(files: DataFrame, text) -> DataFrame:
    """One row per statement: shape, tokens in order, calls, and the comments right before it. ``text`` is the column of the files' text."""
    # an explicit count: tokens outgrow the text, so partitions must not shrink to the text's size
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def beyond_ascii(letters):
        # which characters are letters or digits is for the expression engine that cuts the tokens to say
        return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[\p{{{letters}}}&&[^\x00-\x7F]]"), F.lit(0))), "")
    cut = files.repartition(spread, "path").select(
        "path", "language", F.regexp_extract_all(text, F.lit(G.TOKEN), F.lit(0)).alias("toks"),
        beyond_ascii("L").alias("letters"), beyond_ascii("N").alias("digits"))
    rows = cut.mapInArrow(_placed, STATEMENT)
    noted = F.regexp_replace("shape", rf"(@ {G.NAME}(?: [.:] {G.NAME})*) \( \)", "$1 ~ ~")
    limited = F.regexp_replace("shape", r"\b(private|fileprivate|public|internal|open) \( \)", "$1 ~ ~")
    return (rows.withColumn("shape", F.when(F.contains("shape", F.lit("@ ")), noted).otherwise(F.col("shape")))
            .withColumn("shape", F.when(F.contains("shape", F.lit(" ( )")), limited).otherwise(F.col("shape"))))


def _placed(batches):
    """mapInArrow body: files with their tokens to statements, ``TOKENS`` at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("toks")), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > TOKENS:
                yield from _statements_of(batch.slice(first, row - first))
                first, held = row, 0
            held += size
        if held:
            yield from _statements_of(batch.slice(first))


class _Words:
    """The distinct tokens and what is asked of each; ``code`` holds the word of every token."""

    def __init__(self, flat, letters: str, digits: str):
        encoded = flat.dictionary_encode()
        self.code, self.raw = encoded.indices.to_numpy(), encoded.dictionary
        ticked = pc.starts_with(self.raw, "`")
        self.tok = pc.if_else(ticked, pc.replace_substring(self.raw, " ", "_"), self.raw)
        initial = pc.utf8_slice_codeunits(self.raw, 0, 1).dictionary_encode()
        kinds = np.array([_kind(c, letters, digits) for c in initial.dictionary.to_pylist()], np.int8)[initial.indices.to_numpy()]
        comment = pc.or_(pc.starts_with(self.raw, "//"), pc.starts_with(self.raw, "/*"))
        self.kind = np.where(comment.to_numpy(zero_copy_only=False), COMMENT, kinds).astype(np.int8)

    def among(self, words) -> np.ndarray:
        return pc.is_in(self.raw, value_set=pa.array(list(words), pa.string())).to_numpy(zero_copy_only=False)


def _kind(initial: str, letters: str, digits: str) -> int:
    if initial in " \t\n\x0b\f\r":
        return SPACE
    if initial in "\"'":
        return STRING
    if initial in "_$`" or (initial.isascii() and initial.isalpha()) or initial in letters:
        return NAME
    return NUMBER if (initial.isascii() and initial.isdigit()) or initial in digits else SIGN


def _running(values, starts, sizes):
    """Running sums that begin anew with each file."""
    total = np.cumsum(values, dtype=np.int64)
    return total - np.repeat((total - values)[starts], sizes)


def _latest(flags, first):
    """For each place the last flagged one up to it in its group, or -1; ``first`` flags the first of every group."""
    places = np.arange(len(flags))
    seen = np.maximum.accumulate(np.where(flags, places, -1))
    return np.where(seen >= np.maximum.accumulate(np.where(first, places, 0)), seen, -1)


def _firsts(group):
    return np.r_[True, group[1:] != group[:-1]]


def _contexts(file, level, inner, opens):
    """The row of the bracket around each token; for tokens outside any a number of their file above all rows."""
    n, openers = len(file), np.flatnonzero(opens)
    # an opener stands in its own level and is seen from the level that it opens
    at, lv = np.r_[np.arange(n), openers], np.r_[level, inner[openers]]
    low, width = lv.min(), int(lv.max() - lv.min()) + 1
    key = (file[at] * width + (lv - low)) * n + at
    order = np.argsort(key)
    mark = order >= n
    last = _latest(mark, _firsts(key[order] // n))
    around = np.where(last >= 0, at[order][last], n + file[at][order])
    out = np.empty(n, np.int64)
    out[order[~mark]] = around[~mark]
    return out


def _list(offsets, fields: dict):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _int(values, missing=None):
    return pa.array(values.astype(np.int32), mask=missing)


def _statements_of(rows: pa.RecordBatch):
    """Statements of some files."""
    toks = rows.column("toks")
    counts = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
    full = np.flatnonzero(counts)
    counts, begins = counts[full], np.r_[0, np.cumsum(counts[full])[:-1]]
    words = _Words(toks.flatten(), *("".join(t or "" for t in rows.column(c).to_pylist()) for c in ("letters", "digits")))
    opener, closer = words.among("([{"), words.among(")]}")
    code = words.code
    breaks = pc.count_substring(words.raw, "\n").to_numpy()[code]
    size = pc.binary_length(words.raw).to_numpy()[code]
    pos = _running(np.ones(len(code), np.int64), begins, counts) - 1
    end_byte = _running(size, begins, counts)
    line = _running(breaks, begins, counts)
    inner = _running((opener.astype(np.int8) - closer)[code], begins, counts)
    file = np.repeat(np.arange(len(full)), counts)
    kept = np.flatnonzero(words.kind[code] != SPACE)
    if not len(kept):
        return
    code, pos, end_byte, line, inner, file, breaks, size = (a[kept] for a in (code, pos, end_byte, line, inner, file, breaks, size))
    opens = opener[code]
    ctx = _contexts(file, inner - opens, inner, opens)
    # tokens of a context one after the other; a comment is no neighbour
    seq = np.argsort(ctx * len(ctx) + np.arange(len(ctx)))
    plain = words.kind[code[seq]] != COMMENT
    at = seq[plain]
    if not len(at):
        return
    m, here, group, first = len(at), code[at], ctx[at], _firsts(ctx[at])
    kind, start, end = words.kind[here], (end_byte - size)[at], end_byte[at]
    start_line, end_line = (line - breaks + 1)[at], (line + 1)[at]
    language = np.array(rows.column("language").to_pylist())[full][file[at]]
    java, kotlin, swift = (language == name for name in ("java", "kotlin", "swift"))

    def near(n):
        """Place of the nth neighbour in the same context; m without one."""
        to = np.arange(m) + n
        inside = (to >= 0) & (to < m)
        inside[inside] = group[to[inside]] == group[inside]
        return np.where(inside, to, m)
    l1, l2, l4, r1, r2 = (near(n) for n in (-1, -2, -4, 1, 2))

    def at_place(flags, place):
        return np.r_[flags, False][place]   # nothing holds of a neighbour that is missing

    def is_(*these, of=None):
        flags = words.among(these)[here]
        return flags if of is None else at_place(flags, of)

    def in_language(lists, of=None):
        return java & is_(*lists.get("java", ()), of=of) | kotlin & is_(*lists["kotlin"], of=of) | swift & is_(*lists["swift"], of=of)
    named_before = at_place(kind == NAME, l1)
    word = np.isin(kind, (NAME, NUMBER, STRING))
    annotated = is_("@", of=l2) & named_before | is_(")", of=l1) & is_("(", of=l2) & is_("@", of=l4)
    ends = at_place(word, l1) | is_(")", "]", "}", ">", "?", "!", "*", of=l1)
    begins_new = word & ~is_(*G.CONTINUATIONS) | is_("@")
    new_line = (start_line > np.r_[end_line, 0][l1]) & begins_new & ends & ~in_language(G.MODIFIERS, of=l1) & ~annotated
    after_block = is_("}", of=l1) & is_(*G.DECLARATORS)
    starts = first | is_(";", of=l1) | np.where(java, is_("}", of=l1), new_line | after_block)
    # the first token of the expression a call is applied to
    fresh = (word & ~(is_(".", "new", of=l1) | is_(":", of=l1) & is_(":", of=l2))
             | opens[at] & ~(named_before | is_(")", "]", "}", ">", "!", "?", of=l1)))
    opening, expr = _latest(starts, first), _latest(fresh, first)

    # after "if x" and the like a brace opens a block, not a closure
    closure = ~java & is_("{", of=r1) & (np.r_[start_line, -1][r1] == end_line) & ~is_(*G.BLOCK_WORDS, of=opening)
    dotted = is_(".", of=l1)
    called = ((kind == NAME) & (is_("(", of=r1) | closure) & ~in_language(G.NOT_CALLS) & ~(in_language(G.NOT_BARE_CALLS) & ~dotted)
              & ~(is_("@", "case", "class", "fun", "func", "object", "interface", "is", "as", of=l1) | is_(":", of=l1) & is_("object", of=l2)))
    c = np.flatnonzero(called)
    made, after_dot = (java & is_("new", of=l1))[c], dotted[c]
    safe = (kotlin & is_("?", of=l2))[c]
    origin, far = np.where(after_dot, expr[c], c), np.where(r2[c] < m, r2[c], c)
    call_start = np.where(after_dot, start[origin], np.where(made, np.r_[start, 0][l1[c]], start[c]))

    begin = np.flatnonzero(starts)
    number = np.cumsum(starts) - 1   # the statement of each token, over all contexts
    held = np.searchsorted(c, np.r_[begin, m])
    # a comment leads the statement that the next token of its context starts
    following = np.cumsum(plain)[~plain]
    noted = seq[~plain]
    leads = np.r_[starts, False][following] & (np.r_[group, -1][following] == ctx[noted])
    comment_counts = np.bincount(number[following[leads]], minlength=len(begin))
    opened_by, owner = ctx[at][begin], file[at][begin]
    outside = opened_by >= len(ctx)
    tok = words.tok.take(pa.array(here))
    shown = words.tok.take(pa.array(here)) if not (kind == STRING).any() else pc.if_else(pa.array(kind == STRING), '""', tok)
    offsets = np.r_[begin, m]
    alone = r1 == m
    paths, languages = (rows.column(name).take(pa.array(full[owner])) for name in ("path", "language"))
    no_origin = after_dot & (origin < 0)
    yield pa.RecordBatch.from_arrays([
        paths, languages, _int(np.where(outside, -1, np.r_[pos, np.zeros(len(full), np.int64)][opened_by])),
        pa.array(number[begin] - np.repeat(number[first], np.diff(np.r_[np.flatnonzero(first[begin]), len(begin)])) + 1),
        _list(offsets, {"pos": _int(pos[at]), "tok": tok, "kind": pa.array(np.array(KINDS, object)).take(pa.array(kind)), "start_byte": _int(start),
                        "end_byte": _int(end), "start_line": _int(start_line), "end_line": _int(end_line),
                        "pair_end": _int(np.r_[end, 0][r1], alone), "pair_line": _int(np.r_[end_line, 0][r1], alone)}),
        _list(held, {"spelling": pc.replace_substring(words.tok, "`", "").take(pa.array(here[c])),
                     "role": pa.array(["call", "instantiation"]).take(pa.array(made.astype(np.int8))),
                     "start_byte": _int(call_start, no_origin), "end_byte": _int(end[far]),
                     "start_line": _int(start_line[origin], no_origin), "end_line": _int(end_line[far]),
                     "upto": _int(np.r_[start, 0][np.where(safe, l2[c], l1[c])], ~after_dot), "pos": _int(pos[at][c])}),
        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(comment_counts)], pa.int32()), words.tok.take(pa.array(code[noted[leads]]))),
        pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown), " "),
    ], names=["path", "language", "ctx", "stmt", "items", "calls", "comments", "shape"])
