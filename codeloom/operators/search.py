"""Text search over the search documents, rank fusion and graph-proximity ranking."""

import functools
import operator

from pyspark.sql import DataFrame, Window, functions as F

from codeloom import constants as C
from codeloom.functions import identifiers as ident
from codeloom.functions import paths
from codeloom.functions.like import like_text
from codeloom.operators import graph, lookup, postings
from codeloom.operators.lineage import bounded
from codeloom.operators.postings import index_words  # noqa: F401  (part of this module's interface)
from codeloom.operators.usages import attach

TIE_ORDER = ("path", "entity_type", "entity_id", "title", "body")
HIT = ("entity_type", "entity_id", "title", "path", "body")


def search_documents(symbols: DataFrame, occurrences: DataFrame, docs: DataFrame) -> DataFrame:
    """One searchable row per symbol, occurrence and section; ``kind`` is that of a symbol."""
    sym = symbols.select(
        F.lit("symbol").alias("entity_type"), F.col("sym_id").cast("string").alias("entity_id"),
        F.coalesce("qualified_name", "name").alias("title"), "path",
        F.concat(F.col("signature"), F.lit("\n"), F.coalesce("docstring", F.lit(""))).alias("body"), "kind")
    occ = occurrences.select(
        F.lit("occurrence").alias("entity_type"), F.col("occ_id").cast("string").alias("entity_id"),
        F.col("spelling").alias("title"), "path", F.coalesce("receiver", F.lit("")).alias("body"), F.lit(None).cast("string").alias("kind"))
    doc = docs.select(
        F.lit("doc").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"),
        F.concat("heading", F.lit(" ("), F.array_join("heading_path", " > "), F.lit(")")).alias("title"),
        "path", F.col("content").alias("body"), F.lit(None).cast("string").alias("kind"))
    return sym.unionByName(occ).unionByName(doc)


def query_tokens(spark, query: str) -> list[str]:
    """Query words; a constant expression, so no job runs."""
    row = spark.sql("SELECT 1").select(
        ident.identifier_tokens(F.lit(query)).alias("t"),
        F.regexp_replace(F.lit(query), r"(?U)\W", "").alias("bare")).first()
    return list(row["t"]) or [row["bare"]]


def min_matches(tokens: list[str]) -> int:
    return (len(tokens) + 1) // 2 if len(tokens) >= 3 else 1


def bm25_matches(documents, tokens: list[str], path_prefix: str | None = None) -> DataFrame:
    """Every document (of a text index, or of rows that are indexed first) holding a word that starts with a query token, with its ``bm25`` score.

    Lower is better. Only the blocks of the query's terms and the documents that match are read.
    """
    index = postings.as_index(documents)
    found = postings.folded(index.documents.sparkSession, tokens)
    if not found:
        return index.documents.where(F.lit(False)).select(*HIT, F.lit(0.0).alias("bm25"))
    hits = postings.Query(index, found).matches()
    if path_prefix:
        hits = hits.where(like_text("path", path_prefix + "%"))
    return hits.select(*HIT, "bm25")


def token_overlap(tokens: list[str]):
    """How many query tokens occur anywhere in title or body."""
    haystack = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))))
    return sum((F.when(F.contains(haystack, F.lit(t)), 1).otherwise(0) for t in tokens if t), F.lit(0))


def of_kinds(kinds):
    """Documents of the given types, or symbols of the given kinds."""
    return F.col("kind").isin(*kinds) | F.col("entity_type").isin(*kinds)


def search_text(documents, query: str, path_prefix: str | None = None, limit: int = 15,
                entity_type: str | None = None, kinds=None) -> DataFrame:
    """Best matches, of one type or of some kinds if asked for, with ``bm25`` and a 0-based ``position``; only the top is cut, after all filters. Scores are by
    the figures of all documents."""
    index = postings.as_index(documents)
    spark = index.documents.sparkSession
    tokens = query_tokens(spark, query)
    keep = [F.col("entity_type") == entity_type] if entity_type is not None else []
    if kinds:
        keep.append(of_kinds(kinds))
    if not any(tokens):
        rows = index.documents
        for test in keep:
            rows = rows.where(test)
        return like_fallback(rows, query, limit)
    if path_prefix:
        keep.append(like_text("path", path_prefix + "%"))
    needed = min_matches(tokens)
    if needed > 1:
        keep.append(token_overlap(tokens) >= needed)
    order = (F.round("bm25", 9), *TIE_ORDER)
    found = postings.folded(spark, tokens)
    if not found:
        return _positioned(index.documents.where(F.lit(False)).select(*HIT, F.lit(0.0).alias("bm25")), *order)
    best = postings.Query(index, found).best(limit, functools.reduce(operator.and_, keep) if keep else None, list(order))
    return _positioned(best.select(*HIT, "bm25"), *order)


def _positioned(best: DataFrame, *order) -> DataFrame:
    """Limited rows with their 0-based position; later steps read them several times."""
    return bounded(best.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1))


def like_fallback(documents, query: str, limit: int = 15) -> DataFrame:
    """Plain substring search, for queries without any word."""
    pattern = f"%{query}%"
    documents = documents.documents if isinstance(documents, postings.TextIndex) else documents
    hits = documents.where(paths.any_of(like_text(c, pattern) for c in ("title", "body", "path")))
    best = hits.orderBy(*TIE_ORDER).limit(limit).withColumn("bm25", F.lit(1.0))
    return _positioned(best.select("entity_type", "entity_id", "title", "path", "body", "bm25"), *TIE_ORDER)


def search_exact(symbols: DataFrame, query: str, limit: int = 10, kinds=None) -> DataFrame:
    order = ("path", "start_byte", "symbol_key")
    best = lookup.lookup_symbols(symbols, query)
    if kinds:
        best = best.where(F.col("kind").isin(*kinds) | F.lit("symbol" in kinds))
    best = best.orderBy(*order).limit(limit)
    return _positioned(best, *order)


def fuse(exact: DataFrame, text_hits: DataFrame, symbols: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Weighted reciprocal-rank fusion of an exact and a text result list; both lists must be of ``kinds`` (of symbols or entities) already, if any are
    asked for: a list that is cut before its rows are chosen may hold none of them."""
    left = exact.select(
        F.lit(0).alias("list"), "position", F.col("symbol_key").alias("key"),
        F.lit("symbol").alias("entity_type"), F.col("sym_id").cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("title"), "path", F.lit(None).cast("string").alias("body"), "kind")
    keys = symbols.select(F.col("sym_id").cast("string").alias("entity_id"), "symbol_key", "kind")
    of_symbols = attach(text_hits.where(F.col("entity_type") == "symbol"), keys, "entity_id")
    others = text_hits.where(F.col("entity_type") != "symbol").withColumns({c: F.lit(None).cast("string") for c in ("symbol_key", "kind")})
    right = of_symbols.unionByName(others).select(
        F.lit(1).alias("list"), "position",
        F.coalesce("symbol_key", F.concat("path", F.lit("::"), "title")).alias("key"),
        "entity_type", "entity_id", "title", "path", "body", "kind")

    weight = (F.when(F.col("list") == 0, C.RRF_EXACT_WEIGHT)
              .when(F.col("entity_type") == "occurrence", C.RRF_OCCURRENCE_WEIGHT)
              .otherwise(C.RRF_TEXT_WEIGHT))
    in_title = (F.col("list") == 1) & F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(query.lower()))
    scored = (left.unionByName(right)
              .withColumn("part", weight / (C.RRF_K + F.col("position") + 1)
                          + F.when(in_title, C.RRF_TITLE_BONUS).otherwise(0.0))
              .withColumn("in_title", in_title)
              .withColumn("place", F.struct("list", "position")))
    item = F.min_by(F.struct("entity_type", "entity_id", "title", "path", "body"), "place")
    fused = scored.groupBy("key").agg(
        F.sum("part").alias("raw_score"), F.min("place").alias("place"), item.alias("item"),
        F.bool_or("in_title").alias("titled"), F.bool_or(F.col("list") == 0).alias("was_exact"))
    order = (F.round("raw_score", 12).desc(), "place")
    reason = (F.when(F.col("titled"), "title_exact_phrase_match")
              .when(F.col("was_exact"), "exact_symbol_match").otherwise("fts_lexical_match"))
    return bounded(
        fused.orderBy(*order).limit(limit)
            .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .select("key", "item.*", F.bround("raw_score", 4).alias("score"), "rank",
                    reason.alias("match_reason")))


def context_seeds(symbols: DataFrame, context: str) -> DataFrame:
    """Symbols a context names, with all symbols of the first one's file; or those of the file."""
    found = lookup.lookup_symbols(symbols, context)
    home = found.agg(F.min(F.struct("path", "start_byte", "symbol_key"))["path"]).scalar()
    in_file = symbols.where(F.col("path") == F.coalesce(home, F.lit(context)))
    return found.select("sym_id").unionByName(in_file.select("sym_id")).distinct()


def rerank_by_proximity(ranked: DataFrame, symbols: DataFrame, edges: DataFrame, context: str,
                        limit: int) -> DataFrame:
    """Raise symbols close to the context in the graph; ranks are assigned anew."""
    shown = ranked.where(F.col("entity_type") == "symbol").select(F.col("entity_id").cast(symbols.schema["sym_id"].dataType))   # at most the fetched rows
    distance = graph.proximity_of(edges, context_seeds(symbols, context), shown).select(
        F.col("node").cast("string").alias("entity_id"), F.col("depth").alias("proximity_depth"))
    near = attach(ranked, distance, "entity_id").withColumn(
        "proximity_depth", F.when(F.col("entity_type") == "symbol", F.col("proximity_depth")))
    top = ranked.agg(F.max("score")).scalar()
    top = F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise(top)
    boost = F.when(F.col("proximity_depth").isNotNull(),
                   top * (C.PROXIMITY_WEIGHT / (1 + F.col("proximity_depth")))).otherwise(0.0)
    near = near.withColumn("boosted", F.round(F.col("score") + boost, 12))
    order = (F.col("boosted").desc(), "rank")
    return bounded(
        near.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
        .where(F.col("_rank") <= limit).drop("rank").withColumnRenamed("_rank", "rank"))


def search(symbols: DataFrame, documents, edges: DataFrame, files: DataFrame, query: str,
           path_prefix=None, kinds=None, limit: int = C.SEARCH_LIMIT, context: str | None = None) -> DataFrame:
    """Hybrid search: exact and text lists fused, ranked near the context, files by name added."""
    limit = min(limit or C.SEARCH_LIMIT, C.SEARCH_LIMIT_MAX)
    fetch = limit * 3 if context else limit
    ranked = fuse(search_exact(symbols, query, fetch, kinds),
                  search_text(documents, query, path_prefix, fetch * 2, kinds=kinds), symbols, query, fetch)
    if context:
        ranked = rerank_by_proximity(ranked, symbols, edges, context, limit)
    else:
        ranked = ranked.withColumn("proximity_depth", F.lit(None).cast("int"))
    facts = symbols.select(F.col("sym_id").cast("string").alias("_id"), "symbol_key", "name", "qualified_name",
                           F.col("kind").alias("symbol_kind"), "signature", "start_line", "end_line")
    ranked = ranked.withColumn("_id", F.when(F.col("entity_type") == "symbol", F.col("entity_id")))
    ranked = attach(ranked, facts, "_id").drop("_id")
    named = paths_by_name(ranked, files, query, kinds, limit)
    columns = ["entity_type", "entity_id", "symbol_key", "name", "qualified_name", "symbol_kind", "signature",
               "start_line", "end_line", "title", "path", "body", "score", "rank", "match_reason",
               "proximity_depth"]
    out = ranked.select(*columns, F.lit(0).alias("part"))
    if named is not None:
        out = out.unionByName(named.select(*columns, F.lit(1).alias("part")), allowMissingColumns=True)
    return out.orderBy("part", "rank").limit(limit)


def paths_by_name(ranked: DataFrame, files: DataFrame, query: str, kinds, limit: int):
    """Files whose path holds a filename-shaped query, unless a symbol of that name was found."""
    if kinds and "file" not in kinds:
        return None
    hit = F.coalesce((F.col("qualified_name") == query) | (F.col("name") == query), F.lit(False))
    found = ranked.where(hit).agg(F.count("*")).scalar()
    by_name = (lookup.search_files_by_name(files, query.strip(), limit)
               .where(paths.is_filename_shaped(F.lit(query)) & (found == 0))
               .join(F.broadcast(ranked.select("path").distinct()), "path", "left_anti"))
    order = Window.orderBy(F.length("path"), "path")
    return by_name.select(
        F.lit("file").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("symbol_key"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("qualified_name"), F.lit(None).cast("string").alias("symbol_kind"),
        F.lit(None).cast("string").alias("signature"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        paths.file_name("path").alias("title"), "path", F.lit(None).cast("string").alias("body"),
        F.lit(0.0).alias("score"), F.row_number().over(order).alias("rank"),
        F.lit("filename_match").alias("match_reason"), F.lit(None).cast("int").alias("proximity_depth"))


def feature_context(documents, symbols: DataFrame, docs: DataFrame, feature: str,
                    path_prefix=None) -> DataFrame:
    """Sections and symbols that describe a feature, in display order (block, position)."""
    sections = search_text(documents, feature, path_prefix, 3, "doc")
    direct = search_text(documents, feature, path_prefix, 5, "symbol")
    keyed = attach(direct.select("entity_id", "position"),
                   symbols.withColumn("entity_id", F.col("sym_id").cast("string")), "entity_id").drop("entity_id")
    mentioned = lookup.doc_mentions(sections.select(F.col("body").alias("content")), symbols, keyed)
    order = Window.orderBy("via_mention", "position", "name", "path", "start_byte")
    listed = (keyed.withColumn("via_mention", F.lit(0))
              .unionByName(mentioned.withColumn("position", F.lit(0)).withColumn("via_mention", F.lit(1))))
    listed = (listed.orderBy("via_mention", "position", "name", "path", "start_byte").limit(6)
              .withColumn("position", F.row_number().over(order) - 1))
    section_facts = docs.select(F.col("doc_id").cast("string").alias("entity_id"), "heading_path",
                                "start_line", "end_line")
    shown = attach(sections, section_facts, "entity_id")
    return (shown.select(F.lit("documentation").alias("block"), "position", "path",
                         F.array_join("heading_path", " > ").alias("title"), F.lit(None).cast("string").alias("kind"),
                         "start_line", "end_line", F.col("body").alias("content"), F.lit(None).cast("string").alias("signature"))
            .unionByName(listed.select(
                F.lit("symbols").alias("block"), "position", "path",
                F.coalesce("qualified_name", "name").alias("title"), "kind", "start_line", "end_line",
                F.col("docstring").alias("content"), "signature")))
