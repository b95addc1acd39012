"""Composite answers built from lookups, walks and joins."""

import functools

from pyspark.sql import DataFrame, functions as F

from codeloom import constants as C
from codeloom.functions import paths
from codeloom.operators import graph, lookup


def impact_parts(symbols, occurrences, edges, anchors: DataFrame, depth: int = 2):
    """(callers, implementers, tests) affected by the anchor symbols."""
    seeds = anchors.select("sym_id")
    callers = graph.describe_nodes(graph.upstream_callers(edges, seeds, depth), symbols)
    below = graph.subtypes(edges, seeds)
    implementers = graph.describe_nodes(below, symbols)
    ids = seeds.unionByName(below.select(F.col("node").alias("sym_id")))
    tests = lookup.affected_tests(occurrences, symbols, ids)
    return callers, implementers, tests


def impact_summary(callers, implementers, tests, depth: int) -> DataFrame:
    depth = max(1, min(depth, C.CALL_DEPTH_MAX))
    called = callers.agg(F.count_if(F.col("depth") == 1).alias("direct_callers"),
                         F.count_if(F.col("depth") > 1).alias("transitive_callers"),
                         F.count("*").alias("total_callers"))
    below = implementers.agg(F.count("*").alias("implementers"))
    tested = tests.agg(F.count_distinct("path").alias("affected_test_files"),
                       F.count("*").alias("affected_test_occurrences"))
    return called.select("*", below.scalar().alias("implementers"),
                         tested.select(F.struct("*")).scalar().alias("_t")).select(
        "direct_callers", "transitive_callers", "total_callers", "implementers",
        "_t.affected_test_files", "_t.affected_test_occurrences", F.lit(depth).alias("max_depth"))


def flow_parts(symbols, docs, edges, anchors: DataFrame, depth: int = 1):
    """(callees, callers) around the anchors."""
    seeds = anchors.select("sym_id")
    depth = max(1, min(depth, C.FLOW_DEPTH_MAX))
    callees = graph.describe_nodes(graph.downstream_callees(edges, seeds, depth), symbols)
    callers = graph.describe_nodes(graph.upstream_callers(edges, seeds, 1), symbols)
    return callees, callers


# Reports are rows of text: those of a section come in the order of depth, name, path and line, its heading first.

def _lines(frame: DataFrame, section: int, text, depth=None, name=None, path=None, line=None) -> DataFrame:
    return frame.select(F.lit(section).alias("section"), F.coalesce(depth if depth is not None else F.lit(0), F.lit(0)).cast("int").alias("depth"),
                        *(F.coalesce(c if c is not None else F.lit(""), F.lit("")).alias(n) for n, c in (("name", name), ("path", path))),
                        F.coalesce(line if line is not None else F.lit(0), F.lit(0)).cast("int").alias("line"), text.alias("text"))


def _heading(frame: DataFrame, section: int, title: str) -> DataFrame:
    """The title with the number of all rows."""
    return _lines(frame.agg(F.count("*").alias("_n")), section, F.concat(F.lit(f"\n## {title}: "), F.col("_n").cast("string")), F.lit(-1))


def _place() -> F.Column:
    return F.format_string("%s:%d", F.col("path"), F.col("start_line"))


def _nodes(frame: DataFrame, section: int, title: str) -> DataFrame:
    """Symbols found by a walk: kind, name, place and distance, signature, first line of the documentation."""
    about = F.split(F.trim("docstring"), "\n")[0]
    text = F.concat_ws("\n", F.format_string("- %s %s, %s, distance %d", F.col("kind"), F.coalesce("qualified_name", "name"), _place(), F.col("depth")),
                       F.concat(F.lit("    "), F.col("signature")), F.when(about != "", F.concat(F.lit("    "), about)))
    return _heading(frame, section, title).unionByName(_lines(frame, section, text, F.col("depth"), F.col("name"), F.col("path"), F.col("start_line")))


def _symbol(anchor: DataFrame, title: str) -> DataFrame:
    text = F.concat_ws("\n", F.concat(F.lit(f"# {title} "), F.coalesce("qualified_name", "name")), F.concat_ws(", ", "kind", _place()), "signature")
    return _lines(anchor, 0, text)


def flow_lines(anchor: DataFrame, code: str, fenced: bool, callees: DataFrame, callers: DataFrame, docs: DataFrame) -> DataFrame:
    """A symbol with its code, what it calls, what calls it, and sections about it."""
    text = F.concat(F.lit("```"), paths.display_language("path"), F.lit("\n" + code + "\n```")) if fenced else F.lit(code)
    shown = _lines(anchor, 1, F.concat(F.lit("\n"), text))
    about = _lines(docs, 4, F.concat_ws("\n", F.concat_ws(", ", F.concat(F.lit("- "), F.array_join("heading_path", " > ")), _place()),
                                        F.substring(F.trim("content"), 1, 300)), path=F.col("path"), line=F.col("start_line"))
    parts = [shown, _nodes(callees, 2, "Calls"), _nodes(callers, 3, "Called by"), _heading(docs, 4, "Documents"), about]
    return functools.reduce(DataFrame.unionByName, parts, _symbol(anchor, "Flow of"))


def impact_lines(anchor: DataFrame, callers: DataFrame, implementers: DataFrame, tests: DataFrame | None) -> DataFrame:
    """A symbol with all that a change of it may touch; without tests where None."""
    parts = [_nodes(callers, 1, "Callers"), _nodes(implementers, 2, "Types below it")]
    if tests is not None:
        text = F.concat(F.lit("- "), _place(), F.lit(" "), F.concat_ws(" in ", "spelling", "test_suite_or_method"))
        parts += [_heading(tests, 3, "Uses in tests"), _lines(tests, 3, text, path=F.col("path"), line=F.col("start_line"))]
    return functools.reduce(DataFrame.unionByName, parts, _symbol(anchor, "Impact of"))


def first_lines(lines: DataFrame, most: int) -> DataFrame:
    """The first rows of a report in its order."""
    return lines.orderBy("section", "depth", "name", "path", "line", "text").limit(most)
