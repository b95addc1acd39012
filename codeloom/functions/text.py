"""Scalar expressions over source and document text."""

import unicodedata

from pyspark.sql import Column, functions as F

from codeloom import constants as C
from codeloom.functions.like import _col


def _fold_table():
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = {}
    for start, end in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(start, end):
            base = unicodedata.normalize("NFD", chr(code))
            if len(base) > 1 and base[0].isascii():
                pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()
# line separators beyond "\n" that end a line of source text
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def split_lines(text) -> Column:
    """Lines of a text, without an empty line after a final line break."""
    text = _col(text)
    body = F.regexp_replace(text, "(" + LINE_BREAK + r")\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK))


def fold(text) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(_col(text)), FOLD_FROM, FOLD_TO)


def search_tokens(text) -> Column:
    """Letter and digit runs, folded; camelCase is not split."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}]+"), "")


def numbered_line(number, line, mark=None) -> Column:
    body = F.concat(F.format_string("%4d", _col(number)), F.lit(" | "), _col(line))
    return body if mark is None else F.concat(mark, F.lit(" "), body)


def numbered_slice(lines, first, last, mark_at=None) -> Column:
    """Numbered lines ``first..last`` of a line array, joined by newlines."""
    lines = _col(lines)
    lo = F.greatest(F.lit(1), first)
    hi = F.least(F.size(lines), last)
    span = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    def render(n):
        line = F.element_at(lines, n)
        if mark_at is None:
            return numbered_line(n, line)
        return numbered_line(n, line, F.when(n == mark_at, ">").otherwise(" "))
    return F.array_join(F.transform(span, render), "\n")


def code_snippet(lines, target, context=2) -> Column:
    """Lines around a target, clamped to the file, the target marked with ``>``."""
    at = F.greatest(F.lit(1), F.least(target, F.size(_col(lines))))
    return numbered_slice(lines, at - context, at + context, mark_at=target)


def budget_add(text, used=0, max_chars=C.BUDGET_CHARS) -> Column:
    """Text cut to the characters left in the budget, with a notice if cut."""
    text = _col(text)
    left = F.greatest(F.lit(0), F.lit(max_chars) - (F.lit(used) if isinstance(used, int) else used))
    return F.when(F.length(text) <= left, text).otherwise(
        F.concat(F.substring(text, F.lit(1), left), F.lit(C.BUDGET_NOTICE)))


def fitting_lines(lines, max_chars) -> Column:
    """How many leading lines fit, each costing its length and a line break."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"))

    def step(acc, line):
        used = acc["used"] + F.length(line) + 1
        fits = acc["open"] & (used <= max_chars)
        return F.struct(
            F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(fits, used).otherwise(acc["used"]).alias("used"),
            fits.alias("open"))
    return F.aggregate(_col(lines), state, step, lambda acc: acc["n"])


def truncate_lines(lines, max_chars, label="items") -> Column:
    lines = _col(lines)
    n = fitting_lines(lines, max_chars)
    kept = F.slice(lines, F.lit(1), n)
    notice = F.format_string(C.LINES_NOTICE, n, F.size(lines), F.lit(label))
    return F.when(n == F.size(lines), F.array_join(lines, "\n")).otherwise(
        F.array_join(F.concat(kept, F.array(notice)), "\n"))


def back_reference(name, turn, start_line, end_line) -> Column:
    return F.format_string(C.BACK_REFERENCE, _col(name), _col(turn), _col(start_line), _col(end_line))


def first_line(text) -> Column:
    return F.element_at(F.split(F.regexp_replace(_col(text), r"^\s+|\s+$", ""), "\n"), 1)


def preview(text, chars=200) -> Column:
    return F.substring(F.coalesce(_col(text), F.lit("")), 1, chars)


def elided(text, chars=300) -> Column:
    body = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    return F.when(F.length(body) > chars, F.concat(F.substring(body, 1, chars), F.lit("..."))).otherwise(body)
