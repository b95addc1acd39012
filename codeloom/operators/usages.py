"""Usages of a symbol: matching, filtering, snippets and grouping by file."""

from pyspark.sql import DataFrame, Window, functions as F

from codeloom import constants as C
from codeloom.functions import paths, text
from codeloom.functions.like import contains_like
from codeloom.operators import lookup
from codeloom.operators.lineage import bounded, materialize

ORDER = ("path", "start_byte", "spelling", "receiver", "role", "enclosing_id", "target_id", "start_line")


def split_owner(symbol: str, class_context: str | None = None):
    owner, _, bare = symbol.rpartition(".")
    return (class_context or owner or None), bare


def usage_candidates(symbols: DataFrame, symbol: str, kind=None, class_context=None) -> DataFrame:
    owner, bare = split_owner(symbol, class_context)
    return lookup.lookup_symbols(symbols, bare if owner else symbol, kind, owner, owner_first=True)


def matching_occurrences(occurrences: DataFrame, candidates: DataFrame, symbol: str,
                         class_context=None) -> DataFrame:
    """Occurrences that target a candidate, or carry its name (scoped by receiver if qualified)."""
    owner, bare = split_owner(symbol, class_context)
    ids = materialize(candidates.select(F.col("sym_id").alias("target_id")).distinct())   # written: its size is known, and few ids do not move the occurrences
    first = candidates.agg(F.min(F.struct("path", "start_byte", "symbol_key", "name"))["name"])
    named = occurrences.where(F.col("spelling") == F.coalesce(first.scalar(), F.lit(bare)))
    if owner:
        named = named.where(F.col("target_id").isNull() & contains_like("receiver", F.lit(owner)))
    targeted = occurrences.join(ids, "target_id", "left_semi")
    named = named.join(ids, "target_id", "left_anti")
    cols = occurrences.columns
    return targeted.select(*cols).unionByName(named.select(*cols))


def attach(small: DataFrame, big: DataFrame, key: str) -> DataFrame:
    """Left join a row-limited table to a large one, reading only the matching large rows."""
    keys = F.broadcast(small.select(key).distinct())   # ``small`` is cut by a limit
    return small.join(big.join(keys, key, "left_semi"), key, "left")


def with_status(matches: DataFrame, include_probable: bool = True, min_confidence: float | None = None) -> DataFrame:
    """All matches with ``status``: shown, or the reason to hide them, noise or confidence."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    hidden = F.when(paths.is_noise_path("path"), "noise")
    if min_confidence is not None:
        hidden = hidden.when(confidence < min_confidence, "confidence")
    elif not include_probable:
        hidden = hidden.when(confidence < C.EXACT_CONFIDENCE, "confidence")
    return matches.withColumn("status", F.coalesce(hidden, F.lit("shown")))


def rank_usages(matches: DataFrame, limit: int = C.USAGES_LIMIT, include_probable: bool = True,
                min_confidence: float | None = None) -> DataFrame:
    """The first ``limit`` matches in path order of those that nothing hides, numbered by ``seq``."""
    shown = with_status(matches, include_probable, min_confidence).where(F.col("status") == "shown")
    return bounded(shown.orderBy(*ORDER).limit(limit).withColumn("seq", F.row_number().over(Window.orderBy(*ORDER))))


def count_by_status(matches: DataFrame, include_probable: bool = True, min_confidence: float | None = None, by_tier: bool = False) -> DataFrame:
    """How many of all matches are shown or hidden for each reason, in one aggregate; ``by_tier`` adds how many of them are exact."""
    exact = [F.count_if(F.coalesce("confidence", F.lit(0.0)) >= C.EXACT_CONFIDENCE).alias("exact")] if by_tier else []
    return with_status(matches, include_probable, min_confidence).groupBy("status").agg(F.count("*").alias("n"), *exact)


def describe_usages(ranked: DataFrame, symbols: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Shown usages with their enclosing symbol, class and, given sources, a code snippet."""
    enclosing = symbols.select(F.col("sym_id").alias("enclosing_id"), F.col("name").alias("enclosing_symbol"),
                               F.col("kind").alias("enclosing_kind"))
    rows = attach(ranked, enclosing, "enclosing_id")
    if sources is not None:
        rows = attach(rows, sources.select("path", F.col("text").alias("_text")), "path").withColumn(
            "snippet", F.when(F.col("_text").isNotNull(), text.code_snippet(text.split_lines("_text"), F.col("start_line"))))
    else:
        rows = rows.withColumn("snippet", F.lit(None).cast("string"))
    exact = F.coalesce("confidence", F.lit(0.0)) >= C.EXACT_CONFIDENCE
    shown_confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, C.DISPLAY_CONFIDENCE).otherwise(F.col("confidence"))
    return rows.select(
        F.col("path").alias("file"), "enclosing_symbol", "enclosing_kind",
        F.col("role").alias("occurrence_role"), F.col("start_line").alias("line"),
        F.coalesce("resolution_kind", F.lit("probable")).alias("resolution"),
        shown_confidence.alias("confidence"), "snippet",
        F.when(exact, "exact").otherwise("probable").alias("tier"), "seq")


def group_by_file(usages: DataFrame) -> DataFrame:
    """Files in order of their first usage, exact usages before probable ones."""
    place = F.struct(F.when(F.col("tier") == "exact", 0).otherwise(1).alias("t"), "seq")
    item = F.struct(place.alias("place"), "enclosing_symbol", "enclosing_kind", "occurrence_role", "line",
                    "resolution", "confidence", "snippet")
    return (usages.groupBy("file")
            .agg(F.count("*").alias("count"), F.array_sort(F.collect_list(item)).alias("usages"),
                 F.min(place).alias("first"))
            .orderBy("first").select("file", "count", "usages"))


def generic_names(occurrences: DataFrame, limit: int = C.USAGES_LIMIT) -> DataFrame:
    """Match count of every spelling and whether an unqualified query for it draws a warning."""
    return (occurrences.groupBy("spelling").agg(F.count("*").alias("total_matches"))
            .withColumn("is_generic", F.col("total_matches") > limit * 3))
