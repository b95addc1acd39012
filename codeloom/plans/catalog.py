"""Named queries over the benchmark tables, one per operator of the engine."""

import functools

from pyspark.sql import DataFrame, functions as F

from codeloom.functions import identifiers as ident
from codeloom.functions import paths, text
from codeloom.operators import (build, graph, indexing, lookup, maintain, pysyntax, resolve, search, sections, session,
                                skeleton, syntax, usages)
from codeloom.operators.lineage import materialize, shared_folder
from codeloom.plans import generated, reports
from codeloom.plans.carrier import doc_path, index_of
from codeloom.sources.store import IndexStore
from codeloom.streaming import dedup, watch
from codeloom.streaming import files as streams

QUERIES = {}
LOOKUPS = ["blue_anvil", "Brand12.red_bolt", "java://types/Region.java#ASIA@L3", "java://types/Region.java#ASIA",
           "types.NATION_3", "widget", "unknown.Owner.old_gear(int, int)", "NATION_7@L8", "absent_everywhere"]


def query(build):
    @functools.wraps(build)
    def run(spark, sf_dir) -> DataFrame:
        return build(index_of(spark, sf_dir))
    QUERIES[build.__name__] = run
    return run


def joined(column, separator=" "):
    return F.array_join(column, separator)


# --- scalar functions -----------------------------------------------------------------------

@query
def ident_tokens(c):
    sources = [("part", "p_name"), ("part", "p_brand"), ("documents", "source"), ("events", "event_type"),
               ("customer", "c_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("nation", "n_name")]
    names = functools.reduce(DataFrame.unionByName, (
        c.table(t).select(F.col(col).alias("identifier")).distinct() for t, col in sources))
    return names.select("identifier", joined(ident.identifier_tokens("identifier")).alias("tokens"))


@query
def symbol_key_build(c):
    p = c.table("part").withColumn("path", F.concat(F.lit("\\src\\"), "p_brand", F.lit("\\"), "p_name", F.lit(".java/")))
    owner = F.when(F.col("p_type") != "PROMO", F.col("p_brand"))
    params = F.when(F.col("p_type") != "SMALL", F.concat("p_type", F.lit(" a")))
    line = F.when(F.col("p_type") != "LARGE", F.col("p_size"))
    return p.select("p_partkey", ident.symbol_key(F.lit("java"), "path", owner, "p_name", params, line).alias("symbol_key"))


@query
def symbol_query_parts(c):
    asked = (c.symbols.select(F.explode(F.array("symbol_key", "qualified_name", F.concat("name", F.lit("(x, y)")))).alias("asked"))
             .distinct())
    p = asked.select("asked", ident.parse_symbol_query("asked").alias("p"))
    return p.select("asked", F.coalesce("p.language", F.lit("-")).alias("language"),
                    F.coalesce("p.path_or_owner", F.lit("-")).alias("path_or_owner"), "p.name", "p.raw")


@query
def path_predicates(c):
    every = c.files.select("path").unionByName(c.occurrences.select("path")).distinct()
    return every.select("path", paths.is_noise_path("path").alias("is_noise"), paths.is_test_path("path").alias("is_test"),
                        paths.is_filename_shaped(paths.file_name("path")).alias("is_filename"),
                        paths.display_language("path").alias("language"), paths.file_stem("path").alias("stem"),
                        paths.normalize_path(F.concat(F.lit("./"), F.translate("path", "/", "\\"))).alias("normalized"))


@query
def budget_truncate(c):
    d = c.table("documents")
    return d.select("doc_id", text.budget_add("text", used=100, max_chars=1500).alias("cut"),
                    text.preview("text").alias("preview"), text.first_line("text").alias("first_line"),
                    text.elided("text").alias("elided"))


@query
def budget_truncate_lines(c):
    d = c.table("documents")
    return d.select("doc_id", text.truncate_lines(text.split_lines("text"), 600, "rows").alias("cut"))


@query
def line_numbering(c):
    lines = c.table("documents").select("doc_id", F.posexplode(text.split_lines("text")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), text.numbered_line(F.col("pos") + 1, "line").alias("rendered"))


@query
def line_slice(c):
    d = c.table("documents").withColumn("lines", text.split_lines("text"))
    total = F.size("lines")
    return d.select("doc_id", F.greatest(F.lit(1), F.lit(2)).alias("start"), F.least(total, F.lit(6)).alias("end"),
                    total.alias("total_lines"), text.numbered_slice("lines", F.lit(2), F.lit(6)).alias("content"))


@query
def code_snippets(c):
    d = c.table("documents").withColumn("lines", text.split_lines("text"))
    target = F.least(F.lit(4), F.size("lines"))
    return d.select("doc_id", text.code_snippet("lines", target).alias("snippet"))


# --- discovery and index maintenance --------------------------------------------------------

def _listing(c):
    folder = (F.when(F.col("source") == "src0", "build/").when(F.col("source") == "src1", "builder/")
              .when(F.col("source") == "src2", ".venv/lib/").when(F.col("source") == "src3", "app/.cache/")
              .when(F.col("source") == "src4", "__pycache__/").when(F.col("source") == "src5", "gen/out/")
              .when(F.col("source") == "src6", "tmp/").otherwise(F.concat(F.lit("lib/"), "source", F.lit("/"))))
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", ".txt").otherwise(".kts")
    name = F.when(F.col("source") == "src7", "scratch_").otherwise("file_")
    return c.table("documents").select(
        F.concat(folder, name, F.col("doc_id").cast("string"), ext).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"))


@query
def ignore_filter(c):
    return indexing.discoverable(_listing(c), gitignore=("scratch_*", "tmp/", "gen/out"), max_file_bytes=20000)


@query
def content_hash_drift(c):
    d = c.table("documents")
    scan = d.select(doc_path().alias("path"), F.sha2("text", 256).alias("content_hash"))
    indexed = d.join(c.table("labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        doc_path().alias("path"), F.sha2(F.rtrim("text"), 256).alias("content_hash"))
    gone = c.table("benchmark").select(F.concat(F.lit("docs/old/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"),
                                       F.sha2("text", 256).alias("content_hash"))
    return indexing.drift(scan, indexed.unionByName(gone))


@query
def index_upsert(c):
    prior = c.files.select("path", "content_hash", "size_bytes")
    fresh = c.table("documents").join(c.table("labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select(
        doc_path().alias("path"), F.sha2(F.concat("text", F.lit("!")), 256).alias("content_hash"),
        (F.octet_length("text") + 1).cast("long").alias("size_bytes"))
    removed = c.table("documents").join(c.table("labels").where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").select(doc_path().alias("path"))
    return indexing.upsert(prior, fresh, fresh.select("path").unionByName(removed))


@query
def search_document_rows(c):
    return c.search_documents.drop("kind")


# --- lookups --------------------------------------------------------------------------------

@query
def index_stats(c):
    s = lookup.index_stats(c.files, c.symbols, c.docs, c.occurrences, c.edges)
    entries = F.array_sort(F.map_entries("languages"))
    return s.withColumn("languages", joined(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query
def language_histogram(c):
    return lookup.language_histogram(c.files)


@query
def file_point_lookup(c):
    return lookup.get_file(c.files, "types/Nation.java")


@query
def file_listing(c):
    return lookup.list_files(c.files)


@query
def files_by_name_topk(c):
    return lookup.search_files_by_name(c.files, "en_1", 10).select("path", "language", "size_bytes")


@query
def symbol_lookup_cascade(c):
    return lookup.lookup_many(c.symbols, LOOKUPS).select("query", "stage", "sym_id", "symbol_key")


@query
def symbol_lookup_single(c):
    return lookup.lookup_symbols(c.symbols, "Anvil").select("stage", "sym_id", "symbol_key")


@query
def symbol_disambiguation(c):
    found = lookup.lookup_symbols(c.symbols, "old_gear", kind="method", owner="Brand1")
    return lookup.exact_or_all(found, "old_gear").select("status", "sym_id", "symbol_key", "qualified_name")


@query
def file_symbols(c):
    return lookup.get_file_symbols(c.symbols, "types/Nation.java").select("path", "name", "kind", "start_line", "end_line", "signature")


@query
def file_dependents(c):
    return lookup.file_dependencies(c.symbols, c.resolved, c.edges)


@query
def dependents_of_file(c):
    return lookup.get_file_dependents(c.symbols, c.resolved, c.edges, "types/Nation.java")


@query
def linked_docs_topk(c):
    return lookup.get_linked_docs(c.docs, ["erention", "oueau", ""], "lib/src1.py", 5).select("doc_id", "heading", "heading_level", "path")


@query
def affected_tests(c):
    ids = lookup.lookup_symbols(c.symbols, "red_ring").select("sym_id")
    rows = lookup.affected_tests(c.resolved, c.symbols, ids)
    return rows.select("path", "start_line", "spelling", "role", "confidence", "resolution_kind", "target_id", "target_symbol",
                       "target_symbol_key", F.coalesce("enclosing_id", F.lit(0)).alias("enclosing_id"),
                       F.coalesce("test_suite_or_method", F.lit("-")).alias("test_suite_or_method"))


@query
def file_tree(c):
    return lookup.file_tree(c.files, "docs", depth=1, max_entries=100).unionByName(lookup.file_tree(c.files, "types", 2, 50))


@query
def doc_symbol_mentions(c):
    known = c.symbols.where(F.col("kind") == "interface")
    return lookup.doc_mentions(c.docs, c.symbols, known).select("sym_id", "name", "symbol_key", "path")


# --- resolution -----------------------------------------------------------------------------

@query
def resolve_occurrences(c):
    fresh = resolve.resolve_occurrences(c.occurrences, c.symbols)
    return fresh.select("occ_id", "path", "spelling", F.coalesce("target_id", F.lit(0)).alias("target_id"),
                             "resolution_kind", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query
def resolution_edges(c):
    fresh = resolve.derive_edges(resolve.resolve_occurrences(c.occurrences, c.symbols))
    return fresh.select("source_id", "target_id", "occ_id", "kind", "resolution_kind", "confidence")


def _maintained(c):
    """The resolution of an earlier index, brought up to the present rows by maintenance alone. In the files of a ninth of the paths a third of the symbols were missing, another
    third had other names, and half of the occurrences were missing."""
    touched = materialize(c.symbols.where((F.col("kind") == "method") & (F.pmod(F.xxhash64("path"), F.lit(9)) == 0)).select("path").distinct())
    inside = c.symbols.join(touched, "path", "left_semi")
    old = F.pmod(F.col("sym_id"), F.lit(3))
    before = inside.where(old != 0).withColumn("name", F.when(old == 1, F.concat("name", F.lit("_old"))).otherwise(F.col("name")))
    symbols = materialize(c.symbols.join(touched, "path", "left_anti").unionByName(before))
    present = c.occurrences.join(touched, "path", "left_semi").where(F.pmod("occ_id", F.lit(2)) == 1)
    occurrences = materialize(c.occurrences.join(touched, "path", "left_anti").unionByName(present))
    resolved = materialize(resolve.resolve_occurrences(occurrences, symbols))
    return resolved, touched, maintain.maintain(resolved, c.occurrences, c.symbols, touched, symbols)


@query
def incremental_resolution(c):
    resolved, touched, change = _maintained(c)
    whole = maintain.applied(resolved, change, touched)
    return whole.select("occ_id", "path", "spelling", F.coalesce("target_id", F.lit(0)).alias("target_id"),
                        "resolution_kind", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query
def incremental_edges(c):
    resolved, _, change = _maintained(c)
    return maintain.with_edges(resolve.derive_edges(resolved), maintain.edge_changes(change))


# --- usages ---------------------------------------------------------------------------------

def _matches(c, symbol, kind=None, class_context=None):
    found = usages.usage_candidates(c.symbols, symbol, kind, class_context)
    return usages.matching_occurrences(c.resolved, found, symbol, class_context)


def _usages(c, symbol, kind=None, class_context=None, **options):
    return usages.rank_usages(_matches(c, symbol, kind, class_context), **options)


@query
def usages_ranked(c):
    r = _usages(c, "Brand12.new_bolt", limit=30)
    return r.select("path", "start_line", "spelling", "role", F.coalesce("receiver", F.lit("-")).alias("receiver"),
                    "status", "resolution_kind", "seq")


@query
def usages_exact_only(c):
    return usages.count_by_status(_matches(c, "old_gear"), include_probable=False)


@query
def usages_hidden_counts(c):
    return usages.count_by_status(_matches(c, "hot_plate"), min_confidence=0.5)


@query
def usages_min_confidence(c):
    r = _usages(c, "hot_plate", limit=25, min_confidence=0.5, kind="method")
    return r.select("path", "start_line", "status", "confidence", "seq")


@query
def usages_by_file(c):
    shown = usages.describe_usages(_usages(c, "blue_gizmo", limit=30), c.symbols)
    g = usages.group_by_file(shown)
    lines = F.transform("usages", lambda u: F.concat(
        u["line"].cast("string"), F.lit(":"), u["resolution"], F.lit(":"), F.coalesce(u["enclosing_symbol"], F.lit("-"))))
    return g.select("file", "count", joined(lines, ",").alias("usages"))


@query
def usages_count_warning(c):
    return usages.generic_names(c.occurrences)


# --- graph ----------------------------------------------------------------------------------

def _seeds(c, name):
    return lookup.lookup_symbols(c.symbols, name).select("sym_id")


def _walk(df):
    return df.select("node", "symbol_key", "name", "path", "depth", "via")


@query
def upstream_callers_d4(c):
    return _walk(graph.describe_nodes(graph.upstream_callers(c.edges, _seeds(c, "red_bolt"), 4), c.symbols, "via"))


@query
def downstream_callees_d2(c):
    return _walk(graph.describe_nodes(graph.downstream_callees(c.edges, _seeds(c, "small_widget"), 2), c.symbols, "via"))


@query
def implementations_transitive(c):
    return graph.describe_nodes(graph.subtypes(c.edges, _seeds(c, "AFRICA")), c.symbols).select(
        "node", "name", "kind", "path", "depth", F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("relation"))


@query
def implementations_direct(c):
    return graph.describe_nodes(graph.subtypes(c.edges, _seeds(c, "NATION_3"), transitive=False), c.symbols).select("node", "name", "depth")


@query
def graph_proximity_d3(c):
    return graph.graph_proximity(c.edges, _seeds(c, "NATION_3").unionByName(_seeds(c, "Brand12.red_bolt")))


@query
def impact_summary(c):
    anchors = lookup.lookup_symbols(c.symbols, "old_ring")
    return reports.impact_summary(*reports.impact_parts(c.symbols, c.resolved, c.edges, anchors, 2), 2)


@query
def impact_summary_types(c):
    anchors = lookup.lookup_symbols(c.symbols, "AFRICA")
    return reports.impact_summary(*reports.impact_parts(c.symbols, c.resolved, c.edges, anchors, 4), 4)


@query
def impact_report(c):
    """The whole report on a type as rows of text, with all that is below it, calls it or tests it."""
    anchors = lookup.lookup_symbols(c.symbols, "NATION_3")
    return reports.impact_lines(anchors, *reports.impact_parts(c.symbols, c.resolved, c.edges, anchors, 2))


@query
def impact_report_method(c):
    anchors = lookup.lookup_symbols(c.symbols, "Brand12.red_bolt")
    return reports.impact_lines(anchors, *reports.impact_parts(c.symbols, c.resolved, c.edges, anchors, 2))


@query
def explore_flow(c):
    anchors = lookup.lookup_symbols(c.symbols, "Brand7.cold_plate")
    callees, callers = reports.flow_parts(c.symbols, c.docs, c.edges, anchors, 2)
    return (callees.select(F.lit("callee").alias("side"), "node", "name", "signature", "depth")
            .unionByName(callers.select(F.lit("caller").alias("side"), "node", "name", "signature", "depth")))


# --- search ---------------------------------------------------------------------------------

def _hits(df):
    return df.select("entity_type", "entity_id", "title", "path", F.round("bm25", 6).alias("bm25"), "position")


@query
def bm25_scores(c):
    hits = search.bm25_matches(c.search_index, search.query_tokens(c.spark, "redBolt"))
    return hits.select("entity_type", "entity_id", "title", "path", F.round("bm25", 6).alias("bm25"))


@query
def bm25_search(c):
    return _hits(search.search_text(c.search_index, "erention plate", limit=15))


@query
def bm25_min_match(c):
    return _hits(search.search_text(c.search_index, "erention oueau thanin src1", limit=10))


@query
def bm25_path_prefix(c):
    return _hits(search.search_text(c.search_index, "anvil", "src/Brand1", limit=20))


@query
def text_like_fallback(c):
    return _hits(search.like_fallback(c.search_index, ", le", 10).unionByName(search.like_fallback(c.search_index, "ch. ", 10)))


def _ranked(df):
    return df.select("key", "entity_type", "entity_id", "score", "rank", "match_reason")


@query
def rrf_hybrid(c):
    q = "red_bolt"
    return _ranked(search.fuse(search.search_exact(c.symbols, q, 8), search.search_text(c.search_index, q, None, 16), c.symbols, q, 8))


@query
def proximity_rerank(c):
    q = "NATION_3"
    ranked = search.fuse(search.search_exact(c.symbols, q, 24), search.search_text(c.search_index, q, None, 48), c.symbols, q, 24)
    r = search.rerank_by_proximity(ranked, c.symbols, c.edges, "AFRICA", 8)
    return r.select("key", "entity_type", "score", "rank", F.coalesce("proximity_depth", F.lit(-1)).alias("proximity_depth"))


@query
def hybrid_context(c):
    """The whole hybrid search with a context, not its parts."""
    r = search.search(c.symbols, c.search_index, c.edges, c.files, "NATION_3", limit=8, context="AFRICA")
    return r.select("entity_type", F.coalesce("symbol_key", F.lit("-")).alias("symbol_key"), "path", "score", "rank",
                    F.coalesce("proximity_depth", F.lit(-1)).alias("proximity_depth"))


def _found(df):
    return df.select("entity_type", F.coalesce("symbol_key", F.lit("-")).alias("symbol_key"), F.coalesce("title", F.lit("-")).alias("title"),
                     "path", "score", F.coalesce("rank", F.lit(0)).alias("rank"), "match_reason")


@query
def rrf_kinds_filter(c):
    return _found(search.search(c.symbols, c.search_index, c.edges, c.files, "small_ring", kinds=["method"], limit=10))


@query
def rrf_kinds_deep(c):
    """The wanted kind ranks far below the first rows of both lists: every symbol of a customer holds the words more often."""
    return _found(search.search(c.symbols, c.search_index, c.edges, c.files, "customer java", kinds=["occurrence"], limit=5))


@query
def filename_augment(c):
    return _found(search.search(c.symbols, c.search_index, c.edges, c.files, "economy_1", limit=20))


@query
def entity_enrichment(c):
    hits = search.search_text(c.search_index, "BUILDING erention", limit=20)
    asked = F.broadcast(hits.where(F.col("entity_type") == "occurrence").select(F.col("entity_id").cast("long").alias("occ_id")))   # at most 20
    occurrences = c.resolved.join(asked, "occ_id", "left_semi").dropDuplicates(["occ_id"])
    r = lookup.enrich_entities(hits, c.symbols, c.docs, occurrences)
    return r.select("entity_type", "entity_id", "position", F.coalesce("name", "heading", "spelling").alias("label"),
                    F.coalesce("kind", F.lit("-")).alias("kind"), "start_line")


@query
def feature_context(c):
    r = search.feature_context(c.search_index, c.symbols, c.docs, "erention")
    return r.select("block", "position", "path", "title", F.coalesce("kind", F.lit("-")).alias("kind"), "start_line", "content")


# --- session --------------------------------------------------------------------------------

@query
def session_dedup_window(c):
    requests = c.table("events").select(
        F.col("user_id").alias("session_id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("turn"),
        F.col("event_id").alias("seq"), F.col("event_type").alias("key"), (F.col("value") > 100).alias("force"))
    return session.deduplicate(requests).select("seq", "is_deduplicated", F.coalesce("source_turn", F.lit(-1)).alias("source_turn"))


@query
def session_dedup_conversations(c):
    requests = c.table("conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.lit(0).cast("long").alias("seq"), F.col("role").alias("key"),
        (F.length("text") < 40).alias("force"))
    # several rows of one turn and role are one request
    requests = requests.groupBy("session_id", "turn", "seq", "key").agg(F.bool_or("force").alias("force"))
    out = session.deduplicate(requests).where("is_deduplicated")
    return out.select("session_id", "turn", "key",
                      text.back_reference("key", "source_turn", F.col("turn"), F.col("turn") + 1).alias("reference"))


# --- parsing --------------------------------------------------------------------------------

def _symbol_rows(symbols):
    return symbols.select("path", "name", "qualified_name", "kind", "signature", F.coalesce("docstring", F.lit("-")).alias("docstring"),
                          F.coalesce("parent_key", F.lit("-")).alias("parent_key"), "symbol_key", "start_line", "end_line")


def _reference_rows(references):
    return references.select("path", "spelling", "role", F.coalesce("receiver", F.lit("-")).alias("receiver"), "start_line", "end_line",
                             F.coalesce("enclosing_key", F.lit("-")).alias("enclosing_key"))


def _language_queries(language, parser):
    def symbols(c):
        return _symbol_rows(parser(getattr(generated, language)(c))[0])

    def references(c):
        found, refs, _ = parser(getattr(generated, language)(c))
        return _reference_rows(refs if language == "python" else syntax.enclose_references(refs, found))

    def skeletons(c):
        files = getattr(generated, language)(c)
        return skeleton.render(files, skeleton.redactions(files, parser(files)[0]))
    for build_query, suffix in ((symbols, "symbols"), (references, "references"), (skeletons, "skeletons")):
        build_query.__name__ = f"{language}_{suffix}"
        query(build_query)


for _language in ("java", "kotlin", "swift"):
    _language_queries(_language, syntax.parse)
_language_queries("python", pysyntax.parse)


@query
def parent_links(c):
    """Symbols of the generated files linked to the symbols that enclose them."""
    found = syntax.parse(generated.java(c))[0].withColumn("sym_id", F.md5("symbol_key"))
    names = found.select(F.col("sym_id").alias("parent_id"), F.col("symbol_key").alias("parent"))
    linked = indexing.link_parents(materialize(found)).join(names, "parent_id", "left")
    return linked.select("path", "symbol_key", F.coalesce("parent", F.lit("-")).alias("parent"))


@query
def java_flat_symbols(c):
    return _symbol_rows(syntax.parse(generated.java(c), "flat")[0])


@query
def kotlin_flat_symbols(c):
    return _symbol_rows(syntax.parse(generated.kotlin(c), "flat")[0])


@query
def syntax_error_counts(c):
    broken = generated.java(c).withColumn("content", F.encode(F.regexp_replace(
        F.col("content").cast("string"), r"(?s)\}\s*\z", F.when(F.col("path").contains("Brand1/"), "").otherwise("}")), "UTF-8"))
    return syntax.syntax_errors(syntax.tokens(broken))


@query
def markdown_sections(c):
    return sections.parse(generated.markdown(c)).select(
        "path", "heading_level", "heading", joined("heading_path", " > ").alias("heading_path"), "content",
        "start_line", "end_line", "start_byte", "end_byte")


@query
def markdown_outlines(c):
    return sections.outline(sections.parse(generated.markdown(c)))


@query
def markdown_parents(c):
    docs = sections.parse(generated.markdown(c)).withColumn("doc_id", F.concat("path", F.lit("#"), F.col("start_line").cast("string")))
    linked = indexing.link_doc_parents(docs)
    return linked.select("doc_id", F.coalesce("parent_id", F.lit("-")).alias("parent_id"))


@query
def parsed_call_graph(c):
    """Files to edges: parse the generated Java and Python files, resolve, list the edges."""
    files = generated.java(c).unionByName(generated.python(c))
    files = files.withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("mtime_ns", F.lit(0).cast("long"))
    found = build.build_index(build.with_hash(files))
    # of the wide tables only what resolution and edges read is computed, moved and written
    tables = build.written({"symbols": found["symbols"].select(*maintain.RESOLVED_BY),
                            "occurrences": found["occurrences"].select("occ_id", "path", "enclosing_id", "spelling", "role", "receiver")})
    resolved = resolve.resolve_occurrences(tables["occurrences"], tables["symbols"])
    keys = tables["symbols"].select("sym_id", "symbol_key")
    edges = resolve.derive_edges(resolved)
    return (edges.join(keys.toDF("source_id", "source_key"), "source_id").join(keys.toDF("target_id", "target_key"), "target_id")
            .select("source_key", "target_key", "kind", "resolution_kind", "confidence"))


# --- streaming ------------------------------------------------------------------------------

@query
def session_dedup_stream(c):
    """The event log as a stream of requests, each key with a range of its own."""
    events = streams.replay(c.spark, c.dir, "events")
    requests = events.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("turn"), F.col("event_type").alias("symbol_key"),
        F.col("event_type").alias("symbol_name"), F.concat(F.col("event_type"), F.lit(".py")).alias("path"),
        F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), (F.col("value") > 100).alias("force"))
    out = streams.run_to_table(dedup.deduplicate_stream(requests), "dedup")
    return out.select("seq", "is_deduplicated", F.coalesce("source_turn", F.lit(-1)).alias("source_turn"))


@query
def stream_upsert(c):
    """Documents arrive as a stream and are upserted; then the labelled ones arrive changed."""
    store = IndexStore(c.spark, shared_folder(c.spark, "store"), buckets=16)
    docs = streams.replay(c.spark, c.dir, "documents")
    again = streams.replay(c.spark, c.dir, "labels")
    texts = c.table("documents").select("doc_id", F.concat("text", F.lit("\n\nlabelled")).alias("text"), "source", "lang")

    def as_files(df):
        return df.select(doc_path().alias("path"), F.encode("text", "UTF-8").alias("content"),
                         F.octet_length("text").cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ns"))
    for stream, rows in ((docs, as_files), (again, lambda batch: as_files(texts.join(batch.select("doc_id").distinct(), "doc_id")))):
        (stream.writeStream.foreachBatch(lambda batch, _, rows=rows: watch.sync_batch(store, rows(batch)) and None)
         .option("checkpointLocation", shared_folder(c.spark, "upsert")).trigger(availableNow=True).start().awaitTermination())
    sections_found = store.read("docs").groupBy("path").agg(F.count("*").alias("sections"))
    return store.read("files").join(sections_found, "path").select("path", "language", "content_hash", "size_bytes", "sections")
