"""Relational lookups over the index tables."""

from pyspark.sql import DataFrame, functions as F

from codeloom import constants as C
from codeloom.functions import identifiers as ident
from codeloom.functions import paths
from codeloom.functions.like import contains_like, ends_like, like_text
from codeloom.operators.lineage import materialize

STAGES = 6


def get_file(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def list_files(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def search_files_by_name(files: DataFrame, term: str, limit: int = 10) -> DataFrame:
    return (files.where(like_text("path", f"%{term}%"))
            .orderBy(F.length("path"), "path").limit(limit))


def lookup_stage(query) -> F.Column:
    """How a symbol matches a query: 0 raw key, 1 key, 2 qualified name, 3 name,
    4 suffix of the qualified name or part of the key, 5 name after the last dot."""
    raw, query = query, ident.normalize_lookup(query)
    bare = F.substring_index(query, ".", -1)
    key, qualified, name = F.col("symbol_key"), F.col("qualified_name"), F.col("name")
    ends = ends_like(qualified, query)
    return (F.when(key == raw, 0).when(key == query, 1).when(qualified == query, 2)
            .when(name == query, 3)
            .when(ends | contains_like(key, query), 4)
            .when((bare != "") & (bare != query) & (name == bare), 5))


def lookup_symbols(symbols: DataFrame, query: str, kind: str | None = None, owner: str | None = None,
                   owner_first: bool = False) -> DataFrame:
    """Symbols of the first stage that matches anything.

    Kind and owner narrow them, each only when that leaves something: rows are ranked by
    (stage, misses the first filter, misses the second) and the best rank is kept.
    """
    misses = []
    if kind:
        misses.append(F.coalesce(F.col("kind") != kind, F.lit(True)))
    if owner:
        misses.append(~F.contains(F.coalesce("qualified_name", F.lit("")), F.lit(owner)))
    if owner_first:
        misses.reverse()
    rank = F.array(F.col("stage"), *(m.cast("int") for m in misses))
    staged = (symbols.withColumn("stage", lookup_stage(F.lit(query)))
              .where(F.col("stage").isNotNull()).withColumn("_rank", rank))
    return staged.where(F.col("_rank") == staged.agg(F.min("_rank")).scalar()).drop("_rank")


def lookup_many(symbols: DataFrame, queries: list[str]) -> DataFrame:
    """The cascade for a list of queries in one pass over the symbols."""
    tried = F.array(*(F.struct(F.lit(q).alias("query"), lookup_stage(F.lit(q)).alias("stage"))
                      for q in queries))
    hits = (symbols.withColumn("_hit", F.explode(F.filter(tried, lambda h: h["stage"].isNotNull())))
            .select("*", "_hit.query", "_hit.stage").drop("_hit"))
    first = hits.groupBy("query").agg(F.min("stage").alias("stage"))
    return hits.join(F.broadcast(first), ["query", "stage"])   # one row per listed query


def exact_or_all(candidates: DataFrame, symbol: str) -> DataFrame:
    """A unique exact key or qualified name among several candidates, else all as ambiguous."""
    exact = F.coalesce((F.col("symbol_key") == symbol) | (F.col("qualified_name") == symbol), F.lit(False))
    seen = candidates.agg(F.count("*").alias("n"), F.count_if(exact).alias("exact")).select(F.struct("*")).scalar()
    return (candidates.withColumn("_seen", seen)
            .withColumn("status", F.when((F.col("_seen.n") == 1) | (F.col("_seen.exact") == 1), "success")
                        .otherwise("ambiguous"))
            .where((F.col("_seen.n") == 1) | (F.col("_seen.exact") != 1) | exact).drop("_seen"))


def get_file_symbols(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("start_line", "symbol_key")


def index_counts(files, symbols, docs, occurrences, edges) -> DataFrame:
    """One row per table with its row count."""
    named = {"files": files, "symbols": symbols, "docs": docs,
             "occurrences": occurrences, "resolved_edges": edges}
    out = None
    for name, df in named.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def language_histogram(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("n"))


def index_stats(files, symbols, docs, occurrences, edges) -> DataFrame:
    counts = index_counts(files, symbols, docs, occurrences, edges)
    languages = language_histogram(files).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    wide = counts.groupBy().pivot("metric", ["files", "symbols", "docs", "occurrences", "resolved_edges"]).agg(F.first("n"))
    state = F.when(F.col("files") > 0, "ready").otherwise("empty")
    return wide.select(state.alias("state"), "*", languages.scalar().alias("languages"),
                       F.lit(C.SEMANTIC_MODE).alias("semantic_mode"))


def file_dependencies(symbols: DataFrame, occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (path, dependent): ``dependent`` calls or references symbols of ``path``."""
    home = symbols.select(F.col("sym_id").alias("target_id"), F.col("path").alias("path"))
    caller = symbols.select(F.col("sym_id").alias("source_id"), F.col("path").alias("dependent"))
    via_edges = (edges.select("source_id", "target_id").distinct()
                 .join(home, "target_id").join(caller, "source_id").select("path", "dependent"))
    via_occurrences = (occurrences.where(F.col("target_id").isNotNull())
                       .select("target_id", F.col("path").alias("dependent")).distinct()
                       .join(home, "target_id").select("path", "dependent"))
    return via_edges.unionByName(via_occurrences).where(F.col("path") != F.col("dependent")).distinct()


def get_file_dependents(symbols, occurrences, edges, path: str) -> DataFrame:
    """Files depending on one file; only that file's symbols enter the joins."""
    here = materialize(symbols.where(F.col("path") == path).select(F.col("sym_id").alias("target_id")))
    callers = (materialize(edges.join(here, "target_id", "left_semi").select(F.col("source_id").alias("sym_id")).distinct())
               .join(symbols.select("sym_id", F.col("path").alias("dependent")), "sym_id").select("dependent"))
    users = occurrences.join(here, "target_id", "left_semi").select(F.col("path").alias("dependent"))
    return callers.unionByName(users).where(F.col("dependent") != path).distinct().orderBy("dependent")


def get_linked_docs(docs: DataFrame, names=(), path: str | None = None, limit: int = 5) -> DataFrame:
    """Sections that mention a name, or the file's stem in the heading, or its path in the text."""
    tests = [like_text(c, f"%{n}%") for n in names if n for c in ("heading", "content")]
    if path:
        stem = path.rsplit("/", 1)[-1]
        stem = stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem
        tests += [like_text("heading", f"%{stem}%"), like_text("content", f"%{path}%")]
    return (docs.where(paths.any_of(tests))
            .orderBy("heading_level", F.length("content").desc(), "path", "start_line").limit(limit))


def affected_tests(occurrences: DataFrame, symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """Test-file occurrences of the given symbols, or of their names where unresolved."""
    ids = materialize(ids.toDF("sym_id").distinct())
    in_tests = occurrences.where(paths.is_test_path("path"))
    resolved = in_tests.where(F.col("target_id").isNotNull()).join(
        ids.withColumnRenamed("sym_id", "target_id"), "target_id", "left_semi")
    names = materialize(symbols.join(ids, "sym_id", "left_semi").select(F.col("name").alias("spelling")).distinct())
    unresolved = in_tests.where(F.col("target_id").isNull()).join(names, "spelling", "left_semi")
    hits = resolved.select(*occurrences.columns).unionByName(unresolved.select(*occurrences.columns))
    target = symbols.select(F.col("sym_id").alias("target_id"), F.col("name").alias("target_symbol"),
                            F.col("symbol_key").alias("target_symbol_key"))
    enclosing = symbols.select(F.col("sym_id").alias("enclosing_id"), F.col("name").alias("test_suite_or_method"),
                               F.col("kind").alias("enclosing_kind"))
    return (hits.join(target, "target_id", "left").join(enclosing, "enclosing_id", "left")
            .select("path", "start_line", "end_line", "spelling", "role", "confidence", "resolution_kind",
                    "target_id", "target_symbol", "target_symbol_key", "enclosing_id",
                    "test_suite_or_method", "enclosing_kind")
            .distinct())


def doc_mentions(docs: DataFrame, symbols: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Symbols named by capitalised words in sections, except those whose key is known."""
    words = docs.select(F.explode(ident.camel_mentions("content")).alias("name")).distinct()
    hits = symbols.join(words, "name", "left_semi")
    return hits if known is None else hits.join(known.select("symbol_key"), "symbol_key", "left_anti")


def enrich_entities(hits: DataFrame, symbols: DataFrame, docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Search hits with the columns of the symbol, section or occurrence behind each."""
    sym = symbols.select(F.lit("symbol").alias("entity_type"), F.col("sym_id").cast("string").alias("entity_id"),
                         "symbol_key", "name", "qualified_name", "kind", "signature", "docstring",
                         F.col("start_line").alias("_s1"), F.col("end_line").alias("_e1"))
    doc = docs.select(F.lit("doc").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"),
                      "heading", "heading_path", F.col("start_line").alias("_s2"), F.col("end_line").alias("_e2"))
    occ = (occurrences.select(F.lit("occurrence").alias("entity_type"), F.col("occ_id").cast("string").alias("entity_id"),
                              F.col("spelling"), F.col("role"), F.col("receiver"), F.col("resolution_kind"),
                              F.col("start_line").alias("_s3"), F.col("end_line").alias("_e3")))
    on = ["entity_type", "entity_id"]
    keys = F.broadcast(hits.select(*on).distinct())   # hits are cut by a limit: only their rows leave the large tables
    for rows in (sym, doc, occ):
        hits = hits.join(rows.join(keys, on, "left_semi"), on, "left")
    return (hits.withColumn("start_line", F.coalesce("_s1", "_s2", "_s3"))
            .withColumn("end_line", F.coalesce("_e1", "_e2", "_e3"))
            .drop("_s1", "_s2", "_s3", "_e1", "_e2", "_e3"))


def file_tree(files: DataFrame, prefix: str = "", depth: int | None = 3, max_entries: int = 100) -> DataFrame:
    """Files below a directory, cut by depth and entry count."""
    prefix = "" if prefix in ("", ".") else prefix.rstrip("/") + "/"
    below = files.where(F.startswith("path", F.lit(prefix))) if prefix else files
    if depth is not None:
        rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
        below = below.where(F.size(F.split(rest, "/")) - 1 < depth)
    return below.select("path", "size_bytes", "language").orderBy("path").limit(max_entries or 100)


