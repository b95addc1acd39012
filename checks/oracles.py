"""DuckDB SQL with the results of the catalog queries."""

from checks.prelude import PRELUDE, bm25

SQL = {}


def add(name, body, ctes=""):
    SQL[name] = PRELUDE + ctes + "\n" + body


LOOKUPS = ["blue_anvil", "Brand12.red_bolt", "java://types/Region.java#ASIA@L3", "java://types/Region.java#ASIA",
           "types.NATION_3", "widget", "unknown.Owner.old_gear(int, int)", "NATION_7@L8", "absent_everywhere"]


def lookup_ctes(queries):
    """CTE ``cand``: symbols of the first matching stage of each query."""
    rows = ", ".join(f"('{q}')" for q in queries)
    return rf""", ask AS (SELECT query, trim(regexp_replace(trim(regexp_replace(query, '\([^)]*\)\s*$', '')), '@L\d+\s*$', '')) AS q
      FROM (VALUES {rows}) t(query)),
    asked AS (SELECT *, split_part(q, '.', -1) AS bare FROM ask),
    staged AS (SELECT query, sym.*, CASE WHEN symbol_key = query THEN 0 WHEN symbol_key = q THEN 1 WHEN qualified_name = q THEN 2
       WHEN name = q THEN 3 WHEN qualified_name ILIKE '%' || q OR symbol_key ILIKE '%' || q || '%' THEN 4
       WHEN bare <> q AND bare <> '' AND name = bare THEN 5 END AS stage FROM sym, asked),
    cand AS (SELECT * FROM staged WHERE stage IS NOT NULL
       QUALIFY stage = min(stage) OVER (PARTITION BY query))"""


# --- scalar functions
add("ident_tokens", r"""
SELECT identifier, array_to_string(list_transform(regexp_extract_all(identifier, '[A-Z]?[a-z]+|[A-Z]+|\d+'), lambda w: lower(w)), ' ') AS tokens
FROM (SELECT DISTINCT p_name AS identifier FROM part UNION ALL SELECT DISTINCT p_brand FROM part
      UNION ALL SELECT DISTINCT source FROM documents UNION ALL SELECT DISTINCT event_type FROM events
      UNION ALL SELECT DISTINCT c_name FROM customer UNION ALL SELECT DISTINCT c_mktsegment FROM customer
      UNION ALL SELECT DISTINCT o_orderpriority FROM orders UNION ALL SELECT DISTINCT n_name FROM nation)""")
add("symbol_key_build", r"""
SELECT p_partkey, 'java://src/' || p_brand || '/' || p_name || '.java' || CASE WHEN p_type <> 'PROMO' THEN '::' || p_brand ELSE '' END
  || '#' || p_name || CASE WHEN p_type <> 'SMALL' THEN '(' || p_type || ' a)' ELSE '' END
  || CASE WHEN p_type <> 'LARGE' AND p_size <> 0 THEN '@L' || p_size ELSE '' END AS symbol_key FROM part""")
add("symbol_query_parts", r"""
, asked AS (SELECT DISTINCT unnest([symbol_key, qualified_name, name || '(x, y)']) AS asked FROM sym)
SELECT asked,
  CASE WHEN contains(asked, '://') THEN split_part(asked, '://', 1) ELSE '-' END AS language,
  CASE WHEN contains(asked, '://') THEN regexp_extract(asked, '://(.*)#', 1)
       WHEN contains(asked, '.') THEN regexp_extract(asked, '^(.*)\.', 1) ELSE '-' END AS path_or_owner,
  split_part(CASE WHEN contains(asked, '://') THEN regexp_extract(asked, '([^#]*)$', 1) ELSE regexp_extract(asked, '([^.]*)$', 1) END, '(', 1) AS name,
  asked AS raw FROM asked""")
add("path_predicates", r"""
SELECT path, regexp_matches('/' || lower(path), '/(test|tests|sample|samples|demo|benchmark|mock)/') AS is_noise,
  (regexp_matches(lower(path), 'test.*[./]') AND (path ILIKE '%/tests/%' OR path ILIKE '%/test/%' OR path ILIKE 'tests/%' OR path ILIKE 'test/%'
   OR path ILIKE '%Test.%' OR path ILIKE '%Tests.%' OR path ILIKE '%_test.%' OR path ILIKE '%test_%')) OR path ILIKE '%Spec.%' OR path ILIKE '%test_%' AS is_test,
  regexp_full_match(split_part(path, '/', -1), '[A-Za-z_][A-Za-z0-9_]*(\.\w+)?') AS is_filename,
  CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.kt' OR path LIKE '%.kts' THEN 'kotlin'
       WHEN path LIKE '%.swift' THEN 'swift' WHEN path LIKE '%.md' THEN 'markdown' ELSE 'text' END AS language,
  regexp_replace(split_part(path, '/', -1), '\.[^.]+$', '') AS stem, path AS normalized
FROM (SELECT path FROM file UNION SELECT path FROM occ)""")
NOTICE = r"chr(10) || '... [Output budget limit reached. Refine search or request sub-range]'"
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
add("budget_truncate", rf"""
SELECT doc_id, CASE WHEN length(text) <= 1400 THEN text ELSE left(text, 1400) || {NOTICE} END AS cut, left(text, 200) AS preview,
  split_part({STRIP}, chr(10), 1) AS first_line,
  CASE WHEN length({STRIP}) > 300 THEN left({STRIP}, 300) || '...' ELSE {STRIP} END AS elided FROM documents""")
LINES = r"string_split(regexp_replace(text, '\n$', ''), chr(10))"
add("budget_truncate_lines", rf"""
, line AS (SELECT doc_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS i FROM documents),
run AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM line)
SELECT doc_id, CASE WHEN max(used) <= 600 THEN string_agg(line, chr(10) ORDER BY i)
  ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE used <= 600) || chr(10), '') || chr(10) || '... [Showing '
   || count(*) FILTER (WHERE used <= 600) || ' of ' || count(*) || ' rows. Refine query or request sub-range]' END AS cut
FROM run GROUP BY doc_id""")
add("line_numbering", rf"""
SELECT doc_id, CAST(i AS INTEGER) AS line_no, format('{{:4d}}', i) || ' | ' || line AS rendered
FROM (SELECT doc_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS i FROM documents)""")
add("line_slice", rf"""
SELECT doc_id, 2 AS start, CAST(least(6, len(ls)) AS INTEGER) AS "end", CAST(len(ls) AS INTEGER) AS total_lines,
  array_to_string(list_transform(range(2, least(6, len(ls)) + 1), lambda i: format('{{:4d}}', i) || ' | ' || ls[i]), chr(10)) AS content
FROM (SELECT doc_id, {LINES} AS ls FROM documents)""")
add("code_snippets", rf"""
SELECT doc_id, array_to_string(list_transform(range(greatest(1, t - 2), least(len(ls), t + 2) + 1),
   lambda i: CASE WHEN i = t THEN '>' ELSE ' ' END || ' ' || format('{{:4d}}', i) || ' | ' || ls[i]), chr(10)) AS snippet
FROM (SELECT doc_id, ls, least(4, len(ls)) AS t FROM (SELECT doc_id, {LINES} AS ls FROM documents))""")

# --- discovery and index maintenance
add("ignore_filter", r"""
, listing AS (SELECT CASE source WHEN 'src0' THEN 'build/' WHEN 'src1' THEN 'builder/' WHEN 'src2' THEN '.venv/lib/' WHEN 'src3' THEN 'app/.cache/'
    WHEN 'src4' THEN '__pycache__/' WHEN 'src5' THEN 'gen/out/' WHEN 'src6' THEN 'tmp/' ELSE 'lib/' || source || '/' END
    || CASE source WHEN 'src7' THEN 'scratch_' ELSE 'file_' END || doc_id
    || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.txt' ELSE '.kts' END AS path, strlen(text) AS size_bytes, lang FROM documents)
SELECT path, size_bytes, CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'python' ELSE 'kotlin' END AS language FROM listing
WHERE (path LIKE 'lib/%' OR path LIKE 'builder/%') AND path NOT LIKE '%/scratch!_%' ESCAPE '!' AND path NOT LIKE '%.txt' AND size_bytes <= 20000""")
add("content_hash_drift", r"""
, old AS (SELECT path, sha256(rtrim(content, ' ')) AS h FROM doc WHERE doc_id IN (SELECT doc_id FROM labels)
          UNION ALL SELECT 'docs/old/' || item_id || '.md', sha256(text) FROM benchmark)
SELECT coalesce(d.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted'
  WHEN sha256(content) = h THEN 'unchanged' ELSE 'changed' END AS status
FROM doc d FULL JOIN old ON d.path = old.path""")
add("index_upsert", r"""
, q AS (SELECT doc_id, max(quality) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM labels GROUP BY doc_id)
SELECT path, content_hash, size_bytes FROM file WHERE path NOT IN (SELECT path FROM doc JOIN q USING (doc_id))
UNION ALL SELECT path, sha256(content || '!'), strlen(content) + 1 FROM doc JOIN q USING (doc_id) WHERE good = 1""")
add("search_document_rows", "SELECT * FROM sdoc")

# --- lookups
add("index_stats", r"""
SELECT 'ready' AS state, (SELECT count(*) FROM file) AS files, (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM doc) AS docs,
  (SELECT count(*) FROM occ) AS occurrences, (SELECT count(*) FROM edge) AS resolved_edges,
  (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM file GROUP BY language)) AS languages,
  'lexical-structural' AS semantic_mode""")
add("language_histogram", "SELECT language, count(*) AS n FROM file GROUP BY language")
add("file_point_lookup", "SELECT * FROM file WHERE path = 'types/Nation.java'")
add("file_listing", "SELECT * FROM file")
add("files_by_name_topk", "SELECT path, language, size_bytes FROM file WHERE path ILIKE '%en_1%' ORDER BY length(path), path LIMIT 10")
add("symbol_lookup_cascade", "SELECT query, CAST(stage AS INTEGER) AS stage, sym_id, symbol_key FROM cand", lookup_ctes(LOOKUPS))
add("symbol_lookup_single", "SELECT CAST(stage AS INTEGER) AS stage, sym_id, symbol_key FROM cand", lookup_ctes(["Anvil"]))
add("symbol_disambiguation", r"""
SELECT CASE WHEN (SELECT count(*) FROM cand WHERE contains(qualified_name, 'Brand1')) = 1 THEN 'success' ELSE 'ambiguous' END AS status,
  sym_id, symbol_key, qualified_name FROM cand
WHERE contains(qualified_name, 'Brand1') OR (SELECT count(*) FROM cand WHERE contains(qualified_name, 'Brand1')) = 0""", lookup_ctes(["old_gear"]))
add("file_symbols", "SELECT path, name, kind, start_line, end_line, signature FROM sym WHERE path = 'types/Nation.java'")
add("file_dependents", r"""
SELECT t.path, c.path AS dependent FROM edge JOIN sym t ON target_id = t.sym_id JOIN sym c ON source_id = c.sym_id WHERE t.path <> c.path
UNION SELECT t.path, o.path FROM res o JOIN sym t ON o.target_id = t.sym_id WHERE t.path <> o.path""")
add("dependents_of_file", r"""
SELECT dependent FROM (SELECT t.path, c.path AS dependent FROM edge JOIN sym t ON target_id = t.sym_id JOIN sym c ON source_id = c.sym_id
UNION SELECT t.path, o.path FROM res o JOIN sym t ON o.target_id = t.sym_id) WHERE path = 'types/Nation.java' AND dependent <> path""")
add("linked_docs_topk", r"""
SELECT doc_id, heading, heading_level, path FROM doc
WHERE heading ILIKE '%erention%' OR content ILIKE '%erention%' OR heading ILIKE '%oueau%' OR content ILIKE '%oueau%'
   OR heading ILIKE '%src1%' OR content ILIKE '%lib/src1.py%'
ORDER BY heading_level, length(content) DESC, path, start_line LIMIT 5""")
TEST_PATH = """(o.path ILIKE '%/tests/%' OR o.path ILIKE '%/test/%' OR o.path ILIKE 'tests/%' OR o.path ILIKE 'test/%' OR o.path ILIKE '%Test.%'
  OR o.path ILIKE '%Tests.%' OR o.path ILIKE '%Spec.%' OR o.path ILIKE '%_test.%' OR o.path ILIKE '%test_%')"""


def tests_cte(ids):
    return f""", tested AS (SELECT DISTINCT o.path, o.start_line, o.end_line, o.spelling, o.role, o.confidence, o.resolution_kind, t.sym_id AS target_id,
   t.name AS target_symbol, t.symbol_key AS target_symbol_key, e.sym_id AS enclosing_id, e.name AS test_suite_or_method, e.kind AS enclosing_kind
   FROM res o LEFT JOIN sym t ON o.target_id = t.sym_id LEFT JOIN sym e ON o.enclosing_id = e.sym_id
   WHERE (o.target_id IN ({ids}) OR (o.target_id IS NULL AND o.spelling IN (SELECT name FROM sym WHERE sym_id IN ({ids})))) AND {TEST_PATH})"""


add("affected_tests", r"""
SELECT path, start_line, spelling, role, confidence, resolution_kind, target_id, target_symbol, target_symbol_key,
  coalesce(enclosing_id, 0) AS enclosing_id, coalesce(test_suite_or_method, '-') AS test_suite_or_method FROM tested""",
    lookup_ctes(["red_ring"]) + tests_cte("SELECT sym_id FROM cand"))
add("file_tree", r"""
SELECT path, size_bytes, language FROM (SELECT * FROM file WHERE path LIKE 'docs/%' AND len(string_split(path[6:], '/')) - 1 < 1 ORDER BY path LIMIT 100)
UNION ALL SELECT path, size_bytes, language FROM (SELECT * FROM file WHERE path LIKE 'types/%' AND len(string_split(path[7:], '/')) - 1 < 2 ORDER BY path LIMIT 50)""")
add("doc_symbol_mentions", r"""
SELECT sym_id, name, symbol_key, path FROM sym
WHERE kind <> 'interface' AND name IN (SELECT w FROM (
  SELECT unnest(string_split_regex(content, '[^\p{L}\p{N}_]')) AS w FROM doc) WHERE regexp_full_match(w, '[A-Z][a-zA-Z0-9_]+'))""")

# --- resolution
add("resolve_occurrences", "SELECT occ_id, path, spelling, coalesce(target_id, 0) AS target_id, resolution_kind, coalesce(confidence, 0) AS confidence FROM res")
add("resolution_edges", "SELECT * FROM edge")
add("incremental_resolution", "SELECT occ_id, path, spelling, coalesce(target_id, 0) AS target_id, resolution_kind, coalesce(confidence, 0) AS confidence FROM res")
add("incremental_edges", "SELECT * FROM edge")

# --- usages


def usages_ctes(name, where, limit, hidden):
    return f""", m AS (SELECT * FROM res WHERE {where}),
    st AS (SELECT *, CASE WHEN regexp_matches('/' || lower(path), '/(test|tests|sample|samples|demo|benchmark|mock)/') THEN 'noise' {hidden} ELSE 'shown' END AS status FROM m),
    used AS (SELECT *, CAST(row_number() OVER (ORDER BY path, start_byte, spelling, receiver NULLS FIRST, role, enclosing_id NULLS FIRST, target_id NULLS FIRST, start_line) AS INTEGER) AS seq
      FROM st WHERE status = 'shown' QUALIFY seq <= {limit})"""


add("usages_ranked", "SELECT path, start_line, spelling, role, coalesce(receiver, '-') AS receiver, status, resolution_kind, seq FROM used",
    ", ids AS (SELECT sym_id FROM sym WHERE name = 'new_bolt' AND (contains(qualified_name, 'Brand12') OR (SELECT count(*) FROM sym WHERE name = 'new_bolt' AND contains(qualified_name, 'Brand12')) = 0))"
    + usages_ctes("new_bolt", "target_id IN (SELECT sym_id FROM ids) OR (spelling = 'new_bolt' AND target_id IS NULL AND receiver ILIKE '%Brand12%')", 30, ""))
add("usages_exact_only", "SELECT status, count(*) AS n FROM st GROUP BY status",
    usages_ctes("old_gear", "target_id IN (SELECT sym_id FROM sym WHERE name = 'old_gear') OR spelling = 'old_gear'", 20,
                "WHEN coalesce(confidence, 0) < 0.9 THEN 'confidence'"))
add("usages_hidden_counts", "SELECT status, count(*) AS n FROM st GROUP BY status",
    usages_ctes("hot_plate", "target_id IN (SELECT sym_id FROM sym WHERE name = 'hot_plate') OR spelling = 'hot_plate'", 25,
                "WHEN coalesce(confidence, 0) < 0.5 THEN 'confidence'"))
add("usages_min_confidence", "SELECT path, start_line, status, confidence, seq FROM used",
    usages_ctes("hot_plate", "target_id IN (SELECT sym_id FROM sym WHERE name = 'hot_plate') OR spelling = 'hot_plate'", 25,
                "WHEN coalesce(confidence, 0) < 0.5 THEN 'confidence'"))
add("usages_by_file", r"""
SELECT used.path AS file, count(*) AS count,
  string_agg(start_line || ':' || resolution_kind || ':' || coalesce(name, '-'), ',' ORDER BY CASE WHEN confidence >= 0.9 THEN 0 ELSE 1 END, seq) AS usages
FROM used LEFT JOIN (SELECT sym_id, name FROM sym) e ON enclosing_id = e.sym_id WHERE status = 'shown' GROUP BY used.path""",
    usages_ctes("blue_gizmo", "target_id IN (SELECT sym_id FROM sym WHERE name = 'blue_gizmo') OR spelling = 'blue_gizmo'", 30, ""))
add("usages_count_warning", "SELECT spelling, count(*) AS total_matches, count(*) > 30 AS is_generic FROM occ GROUP BY spelling")

# --- graph


def call_walk(seed, depth, up):
    frm, to = ("target_id", "source_id") if up else ("source_id", "target_id")
    return f""", walk(node, via, depth) AS (
      SELECT {to}, {frm}, 1 FROM call_pair WHERE {frm} IN ({seed})
      UNION SELECT p.{to}, p.{frm}, w.depth + 1 FROM call_pair p JOIN walk w ON p.{frm} = w.node WHERE w.depth < {depth}),
    near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
    walked AS (SELECT w.node, w.depth, min(via) AS via FROM walk w JOIN near n ON w.node = n.node AND w.depth = n.depth GROUP BY w.node, w.depth)"""


WALKED = "SELECT node, symbol_key, name, path, CAST(depth AS INTEGER) AS depth, via FROM walked JOIN sym ON node = sym_id"
add("upstream_callers_d4", WALKED, lookup_ctes(["red_bolt"]) + call_walk("SELECT sym_id FROM cand", 4, True))
add("downstream_callees_d2", WALKED, lookup_ctes(["small_widget"]) + call_walk("SELECT sym_id FROM cand", 2, False))


def type_walk(seed, name="below"):
    return f""", {name}(node, depth) AS (
      SELECT source_id, 1 FROM type_pair WHERE target_id IN ({seed})
      UNION SELECT p.source_id, b.depth + 1 FROM type_pair p JOIN {name} b ON p.target_id = b.node WHERE b.depth < 20)"""


add("implementations_transitive", r"""
SELECT node, name, kind, path, CAST(depth AS INTEGER) AS depth, CASE depth WHEN 1 THEN 'direct' ELSE 'indirect' END AS relation
FROM below JOIN sym ON node = sym_id""", lookup_ctes(["AFRICA"]) + type_walk("SELECT sym_id FROM cand"))
add("implementations_direct", "SELECT source_id AS node, name, 1 AS depth FROM type_pair JOIN sym ON source_id = sym_id WHERE target_id IN (SELECT sym_id FROM cand)",
    lookup_ctes(["NATION_3"]))


def near_walk(seed):
    return f""", prox(node, depth) AS (
      SELECT sym_id, 0 FROM ({seed}) UNION SELECT b, depth + 1 FROM any_pair JOIN prox ON a = node WHERE depth < 3),
    dist AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM prox GROUP BY node)"""


add("graph_proximity_d3", "SELECT node, depth FROM dist", lookup_ctes(["NATION_3", "Brand12.red_bolt"]) + near_walk("SELECT sym_id FROM cand"))
SUMMARY = """
SELECT (SELECT count(*) FROM walked WHERE depth = 1) AS direct_callers, (SELECT count(*) FROM walked WHERE depth > 1) AS transitive_callers,
  (SELECT count(*) FROM walked) AS total_callers, (SELECT count(*) FROM below) AS implementers,
  (SELECT count(DISTINCT path) FROM tested) AS affected_test_files, (SELECT count(*) FROM tested) AS affected_test_occurrences, %d AS max_depth"""
IMPACTED = "SELECT sym_id FROM cand UNION SELECT node FROM below"
for key, symbol, depth in (("impact_summary", "old_ring", 2), ("impact_summary_types", "AFRICA", 4)):
    add(key, SUMMARY % depth, lookup_ctes([symbol]) + call_walk("SELECT sym_id FROM cand", depth, True)
        + type_walk("SELECT sym_id FROM cand") + tests_cte(IMPACTED))
PLACE = "path || ':' || start_line"


def report_nodes(source, section, title):
    """A heading and the rows of symbols that a walk found."""
    return f"""
UNION ALL SELECT {section}, -1, '', '', 0, chr(10) || '## {title}: ' || count(*) FROM {source}
UNION ALL SELECT {section}, CAST(depth AS INTEGER), name, path, start_line,
  '- ' || kind || ' ' || coalesce(qualified_name, name) || ', ' || {PLACE} || ', distance ' || depth || chr(10) || '    ' || signature
  || CASE WHEN split_part(trim(docstring), chr(10), 1) <> '' THEN chr(10) || '    ' || split_part(trim(docstring), chr(10), 1) ELSE '' END
FROM {source} JOIN sym ON node = sym_id"""


for key, symbol in (("impact_report", "NATION_3"), ("impact_report_method", "Brand12.red_bolt")):
    add(key, f"""
SELECT 0 AS section, 0 AS depth, '' AS name, '' AS path, 0 AS line,
  '# Impact of ' || coalesce(qualified_name, name) || chr(10) || kind || ', ' || {PLACE} || chr(10) || signature AS text FROM cand"""
        + report_nodes("walked", 1, "Callers") + report_nodes("below", 2, "Types below it") + f"""
UNION ALL SELECT 3, -1, '', '', 0, chr(10) || '## Uses in tests: ' || count(*) FROM tested
UNION ALL SELECT 3, 0, '', path, start_line, '- ' || {PLACE} || ' ' || concat_ws(' in ', spelling, test_suite_or_method) FROM tested""",
        lookup_ctes([symbol]) + call_walk("SELECT sym_id FROM cand", 2, True) + type_walk("SELECT sym_id FROM cand") + tests_cte(IMPACTED))
add("explore_flow", r"""
, callers AS (SELECT DISTINCT source_id AS node FROM call_pair WHERE target_id IN (SELECT sym_id FROM cand))
SELECT 'callee' AS side, node, name, signature, CAST(depth AS INTEGER) AS depth FROM walked JOIN sym ON node = sym_id
UNION ALL SELECT 'caller', node, name, signature, 1 FROM callers JOIN sym ON node = sym_id""",
    lookup_ctes(["Brand7.cold_plate"]) + call_walk("SELECT sym_id FROM cand", 2, False))

# --- search
ORDER = "round(bm25, 9), path, entity_type, entity_id, title, body"
POSITION = f"CAST(row_number() OVER (ORDER BY {ORDER}) - 1 AS INTEGER) AS position"
HITS = "SELECT entity_type, entity_id, title, path, round(bm25, 6) AS bm25, position FROM best"


def best_cte(tokens, limit, prefix=None, name="best", source="hit"):
    if len(tokens) < 3:
        return f", {name} AS (SELECT *, {POSITION} FROM (SELECT * FROM {source} ORDER BY {ORDER} LIMIT {limit}))"
    overlap = " + ".join(f"CASE WHEN contains(lower(title || ' ' || body), '{t}') THEN 1 ELSE 0 END" for t in tokens)
    return (f", {name} AS (SELECT *, {POSITION} FROM (SELECT * FROM {source}"
            f" WHERE {overlap} >= {(len(tokens) + 1) // 2} ORDER BY {ORDER} LIMIT {limit}))")


add("bm25_scores", "SELECT entity_type, entity_id, title, path, round(bm25, 6) AS bm25 FROM hit", bm25(["red", "bolt"]))
add("bm25_search", HITS, bm25(["erention", "plate"]) + best_cte(["erention", "plate"], 15))
FOUR = ["erention", "oueau", "thanin", "src", "1"]
add("bm25_min_match", HITS, bm25(FOUR) + best_cte(FOUR, 10))
add("bm25_path_prefix", HITS, bm25(["anvil"], "src/Brand1") + best_cte(["anvil"], 20))


def like_hits(q):
    return (f"SELECT entity_type, entity_id, title, path, 1.0::DOUBLE AS bm25, CAST(row_number() OVER (ORDER BY path, entity_type, entity_id, title, body) - 1 AS INTEGER) AS position"
            f" FROM (SELECT * FROM sdoc WHERE title ILIKE '%{q}%' OR body ILIKE '%{q}%' OR path ILIKE '%{q}%' ORDER BY path, entity_type, entity_id, title, body LIMIT 10)")


add("text_like_fallback", like_hits(", le") + " UNION ALL " + like_hits("ch. "))


def fused_ctes(query, tokens, fetch, limit, kind=None):
    """CTE ``fused`` with key, item, score, rank, match_reason; both lists hold only rows of ``kind`` before they are cut."""
    exact = f"WHERE kind = '{kind}'" if kind else ""
    text = f"WHERE entity_type = '{kind}' OR entity_type = 'symbol' AND entity_id IN (SELECT CAST(sym_id AS VARCHAR) FROM sym WHERE kind = '{kind}')" if kind else ""
    return (lookup_ctes([query]) + bm25(tokens) + f", wanted AS (SELECT * FROM hit {text})" + best_cte(tokens, fetch * 2, source="wanted") + f"""
    , ex AS (SELECT *, row_number() OVER (ORDER BY path, start_byte, symbol_key) - 1 AS position FROM (SELECT * FROM cand {exact} ORDER BY path, start_byte, symbol_key LIMIT {fetch})),
    parts AS (
      SELECT 0 AS list, position, symbol_key AS key, 'symbol' AS entity_type, CAST(sym_id AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS title, path, CAST(NULL AS VARCHAR) AS body,
             1.5 / (60.0 + position + 1)::DOUBLE AS part, false AS titled FROM ex
      UNION ALL
      SELECT 1, b.position, CASE WHEN b.entity_type = 'symbol' THEN s.symbol_key ELSE b.path || '::' || b.title END, b.entity_type, b.entity_id, b.title, b.path, b.body,
             (CASE WHEN b.entity_type = 'occurrence' THEN 0.3 ELSE 1.0 END) / (60.0 + b.position + 1)::DOUBLE
             + CASE WHEN contains(lower(b.title), '{query.lower()}') THEN 0.02 ELSE 0 END, contains(lower(b.title), '{query.lower()}')
      FROM best b LEFT JOIN sym s ON b.entity_type = 'symbol' AND b.entity_id = CAST(s.sym_id AS VARCHAR)),
    grouped AS (
      SELECT key, sum(part) AS raw, min(list * 1000000 + position) AS place, first(entity_type ORDER BY list, position) AS entity_type,
        first(entity_id ORDER BY list, position) AS entity_id, first(title ORDER BY list, position) AS title, first(path ORDER BY list, position) AS path,
        bool_or(titled) AS titled, bool_or(list = 0) AS was_exact FROM parts GROUP BY key),
    fused AS (
      SELECT key, entity_type, entity_id, title, path, round_even(raw, 4) AS score,
        CAST(row_number() OVER (ORDER BY round(raw, 12) DESC, place) AS INTEGER) AS rank,
        CASE WHEN titled THEN 'title_exact_phrase_match' WHEN was_exact THEN 'exact_symbol_match' ELSE 'fts_lexical_match' END AS match_reason
      FROM grouped QUALIFY rank <= {limit})""")


add("rrf_hybrid", "SELECT key, entity_type, entity_id, score, rank, match_reason FROM fused", fused_ctes("red_bolt", ["red", "bolt"], 8, 8))
add("proximity_rerank", r"""
, b AS (SELECT f.*, CASE WHEN entity_type = 'symbol' THEN d.depth END AS pd FROM fused f LEFT JOIN dist d ON entity_type = 'symbol' AND entity_id = CAST(d.node AS VARCHAR)),
r AS (SELECT *, row_number() OVER (ORDER BY round(score + CASE WHEN pd IS NOT NULL THEN (SELECT max(score) FROM fused) * (0.5 / (1 + pd)) ELSE 0 END, 12) DESC, rank) AS nr FROM b)
SELECT key, entity_type, score, CAST(nr AS INTEGER) AS rank, coalesce(pd, -1) AS proximity_depth FROM r WHERE nr <= 8""",
    fused_ctes("NATION_3", ["nation", "3"], 24, 24) + near_walk("SELECT sym_id FROM sym WHERE path = 'types/Region.java'"))
add("hybrid_context", r"""
, b AS (SELECT f.*, CASE WHEN entity_type = 'symbol' THEN d.depth END AS pd FROM fused f LEFT JOIN dist d ON entity_type = 'symbol' AND entity_id = CAST(d.node AS VARCHAR)),
r AS (SELECT *, row_number() OVER (ORDER BY round(score + CASE WHEN pd IS NOT NULL THEN (SELECT max(score) FROM fused) * (0.5 / (1 + pd)) ELSE 0 END, 12) DESC, rank) AS nr FROM b)
SELECT entity_type, coalesce(symbol_key, '-') AS symbol_key, r.path, score, CAST(nr AS INTEGER) AS rank, coalesce(pd, -1) AS proximity_depth
FROM r LEFT JOIN (SELECT sym_id, symbol_key FROM sym) s ON entity_type = 'symbol' AND entity_id = CAST(s.sym_id AS VARCHAR) WHERE nr <= 8""",
    fused_ctes("NATION_3", ["nation", "3"], 24, 24) + near_walk("SELECT sym_id FROM sym WHERE path = 'types/Region.java'"))
FOUND = """SELECT entity_type, coalesce(symbol_key, '-') AS symbol_key, coalesce(title, '-') AS title, f.path, score, rank, match_reason
FROM fused f LEFT JOIN (SELECT sym_id, symbol_key, kind, name, qualified_name FROM sym) s ON entity_type = 'symbol' AND entity_id = CAST(s.sym_id AS VARCHAR)"""
add("rrf_kinds_filter", FOUND, fused_ctes("small_ring", ["small", "ring"], 10, 10, "method"))
add("rrf_kinds_deep", FOUND, fused_ctes("customer java", ["customer", "java"], 5, 5, "occurrence"))
add("filename_augment", f"""
, ranked AS ({FOUND}),
named AS (SELECT * FROM (SELECT * FROM file WHERE path ILIKE '%economy_1%' ORDER BY length(path), path LIMIT 20) WHERE path NOT IN (SELECT path FROM ranked)),
every AS (SELECT *, 0 AS part FROM ranked UNION ALL
  SELECT 'file', '-', split_part(path, '/', -1), path, 0.0, CAST(row_number() OVER (ORDER BY length(path), path) AS INTEGER), 'filename_match', 1 FROM named)
SELECT entity_type, symbol_key, title, path, score, rank, match_reason FROM every ORDER BY part, rank LIMIT 20""",
    fused_ctes("economy_1", ["economy", "1"], 20, 20))
add("entity_enrichment", r"""
SELECT entity_type, entity_id, position, coalesce(s.name, d.heading, o.spelling) AS label, coalesce(s.kind, '-') AS kind,
  coalesce(s.start_line, d.start_line, o.start_line) AS start_line
FROM best b LEFT JOIN sym s ON entity_type = 'symbol' AND entity_id = CAST(s.sym_id AS VARCHAR)
 LEFT JOIN doc d ON entity_type = 'doc' AND entity_id = CAST(d.doc_id AS VARCHAR)
 LEFT JOIN (SELECT occ_id, any_value(spelling) AS spelling, any_value(start_line) AS start_line FROM occ GROUP BY occ_id) o
   ON entity_type = 'occurrence' AND entity_id = CAST(o.occ_id AS VARCHAR)""",
    bm25(["building", "erention"]) + best_cte(["building", "erention"], 20))
add("feature_context", r"""
, secs AS (SELECT b.position, b.path, d.heading_path, d.start_line, b.body FROM b3 b JOIN doc d ON b.entity_id = CAST(d.doc_id AS VARCHAR) WHERE entity_type = 'doc'),
direct AS (SELECT b.position, s.* FROM b5 b JOIN sym s ON entity_type = 'symbol' AND entity_id = CAST(s.sym_id AS VARCHAR)),
word AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(body, '[^\p{L}\p{N}_]')) AS w FROM secs) WHERE regexp_full_match(w, '[A-Z][a-zA-Z0-9_]+')),
mention AS (SELECT 0 AS position, * FROM sym WHERE name IN (SELECT w FROM word) AND symbol_key NOT IN (SELECT symbol_key FROM direct)),
listed AS (SELECT *, row_number() OVER (ORDER BY via, position, name, path, start_byte) - 1 AS p
  FROM (SELECT 0 AS via, * FROM direct UNION ALL SELECT 1, * FROM mention) QUALIFY p < 6)
SELECT 'documentation' AS block, position, path, heading_path AS title, '-' AS kind, start_line, body AS content FROM secs
UNION ALL SELECT 'symbols', CAST(p AS INTEGER), path, coalesce(qualified_name, name), kind, start_line, docstring FROM listed""",
    bm25(["erention"]) + best_cte(["erention"], 3, name="b3", source="(SELECT * FROM hit WHERE entity_type = 'doc')")
    + best_cte(["erention"], 5, name="b5", source="(SELECT * FROM hit WHERE entity_type = 'symbol')"))

# --- session: the tracker's rules, row by row
SESSION = r"""
, first_turn AS (SELECT session_id, key, min(turn) AS ft FROM req GROUP BY session_id, key),
judged AS (
  SELECT req.*, ft, max(CASE WHEN force THEN turn END) OVER (PARTITION BY session_id, key ORDER BY turn, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf,
         row_number() OVER (PARTITION BY session_id, key ORDER BY turn, seq) AS rn
  FROM req JOIN first_turn USING (session_id, key)),
last AS (SELECT *, CASE WHEN rn > 1 THEN greatest(ft, coalesce(lf, ft)) END AS last_turn FROM judged),
dedup AS (SELECT *, NOT force AND last_turn IS NOT NULL AND last_turn < turn AS is_deduplicated FROM last)"""
add("session_dedup_window", "SELECT seq, is_deduplicated, CAST(CASE WHEN is_deduplicated THEN last_turn ELSE -1 END AS INTEGER) AS source_turn FROM dedup",
    ", req AS (SELECT user_id AS session_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS turn, event_id AS seq, event_type AS key, value > 100 AS force FROM events)" + SESSION)
add("session_dedup_conversations", r"""
SELECT session_id, turn, key, '[Source for Symbol ' || key || ' already provided in Turn ' || last_turn || ' (L' || turn || '-L' || (turn + 1)
  || '). Omitted to preserve token budget. Pass force=True or call read_lines to inspect.]' AS reference FROM dedup WHERE is_deduplicated""",
    ", req AS (SELECT conv_id AS session_id, turn, 0 AS seq, role AS key, bool_or(length(text) < 40) AS force FROM conversations GROUP BY conv_id, turn, role)" + SESSION)

# --- parsing: the generated files have fixed lines, so the expected rows are written out per file


def file_rows(source, rows):
    """Rows of literals and expressions, one per entry, for every row of ``source``."""
    return " UNION ALL ".join(f"SELECT {', '.join(f'{e} AS {n}' for n, e in row.items())} FROM {source}" for row in rows)


def symbol_rows(source, language, path, entries):
    """entries: (name, owner, kind, signature, docstring, parent, params, first, last), SQL expressions."""
    rows = []
    for name, owner, kind, signature, doc, parent, params, first, last in entries:
        key = (f"'{language}://' || {path} || CASE WHEN {owner} <> '' THEN '::' || {owner} ELSE '' END || '#' || {name}"
               f" || {params} || '@L{first}'")
        rows.append({"path": path, "name": name, "qualified_name": f"CASE WHEN {owner} <> '' THEN {owner} || '.' || {name} ELSE {name} END",
                     "kind": f"'{kind}'", "signature": signature, "docstring": doc, "parent_key": parent, "symbol_key": key,
                     "start_line": str(first), "end_line": str(last)})
    return file_rows(source, rows)


def reference_rows(path, source, entries):
    """entries: (spelling, role, receiver, first, last, enclosing)."""
    return file_rows(source, [
        {"path": path, "spelling": s, "role": f"'{r}'", "receiver": v, "start_line": str(a), "end_line": str(b), "enclosing_key": e}
        for s, r, v, a, b, e in entries])


NONE = "'-'"
# Java: one file per part
JAVA = """(SELECT p_partkey AS k, replace(p_brand, '#', '') AS brand, upper(left(p_type, 1)) || lower(p_type[2:]) AS ty, p_size AS size, p_name AS nm,
  'gen/' || replace(p_brand, '#', '') || '/Part' || p_partkey || '.java' AS path FROM part)"""
J_CLASS = "'java://' || path || '::com.acme.' || brand || '#Part' || k || '@L6'"
J_SHIP = "'java://' || path || '::Part' || k || '#ship' || size || '(int count, String note)@L10'"
J_AUDIT = "'java://' || path || '::Part' || k || '#audit()@L18'"
add("java_symbols", symbol_rows(JAVA, "java", "path", [
    ("'Part' || k", "'com.acme.' || brand", "class", "'public class Part' || k || ' extends Base' || brand || ' implements ' || ty || 'Item'",
     "ty || ' part.'", NONE, "''", 6, 22),
    ("'ship' || size", "'Part' || k", "method", "'@Override' || chr(10) || '    public Map<String, Integer> ship' || size || '(int count, String note)'",
     "'Ships the part.'", J_CLASS, "'(int count, String note)'", 10, 16),
    ("'audit'", "'Part' || k", "method", "'void audit()'", NONE, J_CLASS, "'()'", 18, 21)]))
JAVA_REFS = [
    ("'Base' || brand", "extends", NONE, 6, 6, J_CLASS), ("ty || 'Item'", "implements", NONE, 6, 6, J_CLASS),
    ("'reserve' || size", "call", "'store' || brand", 13, 13, J_SHIP), ("'open'", "call", "'ledger'", 15, 15, J_SHIP),
    ("'close' || size", "call", "'ledger.open(\"' || ty || ' (x)\")'", 15, 15, J_SHIP),
    ("'ship' || size", "call", NONE, 19, 19, J_AUDIT), ("'Ledger' || size", "instantiation", NONE, 20, 20, J_AUDIT)]
add("java_references", reference_rows("path", JAVA, JAVA_REFS))
# Kotlin: one file per supplier
KOTLIN = "(SELECT s_suppkey AS k, s_nationkey AS n, 'gen/Supplier' || s_suppkey || '.kt' AS path FROM supplier)"
K_DESK = "'kotlin://' || path || '::com.acme.n' || n || '#Shipper' || k || '@L3'"
K_CLASS = "'kotlin://' || path || '::com.acme.n' || n || '#Supplier' || k || '@L8'"
K_OFFER = "'kotlin://' || path || '::Supplier' || k || '#offer' || k || '(part: String, count: Int)@L10'"
K_RANK = "'kotlin://' || path || '::Supplier' || k || '#rank()@L16'"
add("kotlin_symbols", symbol_rows(KOTLIN, "kotlin", "path", [
    ("'Shipper' || k", "'com.acme.n' || n", "class", "'interface Shipper' || k", NONE, NONE, "''", 3, 5),
    ("'price' || n", "'Shipper' || k", "method", "'fun price' || n || '(id: String): Int'", NONE, K_DESK, "'(id: String)'", 4, 4),
    ("'Supplier' || k", "'com.acme.n' || n", "class", "'class Supplier' || k || '(private val desk: Desk) : Nation' || n || '(desk), Trader'",
     "'Ships goods.'", NONE, "''", 8, 19),
    ("'offer' || k", "'Supplier' || k", "method", "'@Deprecated(\"old\")' || chr(10) || '    suspend fun offer' || k || '(part: String, count: Int): Boolean'",
     NONE, K_CLASS, "'(part: String, count: Int)'", 10, 14),
    ("'rank'", "'Supplier' || k", "method", "'fun rank(): Int'", NONE, K_CLASS, "'()'", 16, 18)]))
add("kotlin_references", reference_rows("path", KOTLIN, [
    ("'Nation' || n", "extends", NONE, 8, 8, K_CLASS), ("'Trader'", "implements", NONE, 8, 8, K_CLASS),
    ("'quote' || n", "call", "'desk'", 12, 12, K_OFFER), ("'missing'", "call", NONE, 12, 12, K_OFFER),
    ("'score' || n", "call", NONE, 16, 18, K_RANK)]))
# Swift: one file per customer
SWIFT = """(SELECT c_custkey AS k, c_nationkey AS n, upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) AS seg,
  'gen/Customer' || c_custkey || '.swift' AS path FROM customer)"""
S_CLASS = "'swift://' || path || '#Customer' || k || '@L4'"
S_INIT = "'swift://' || path || '::Customer' || k || '#init@L7'"
S_PAY = "'swift://' || path || '::Customer' || k || '#pay' || n || '@L11'"
add("swift_symbols", symbol_rows(SWIFT, "swift", "path", [
    ("'Customer' || k", "''", "class", "'public struct Customer' || k || ': Account, ' || seg", "'Customer account.'", NONE, "''", 4, 17),
    ("'init'", "'Customer' || k", "method", "'public init(name: String)'", NONE, S_CLASS, "''", 7, 9),
    ("'pay' || n", "'Customer' || k", "method", "'func pay' || n || '(amount: Int) -> Bool'", NONE, S_CLASS, "''", 11, 16)]))
add("swift_references", reference_rows("path", SWIFT, [
    ("'Account'", "implements", NONE, 4, 4, S_CLASS), ("seg", "implements", NONE, 4, 4, S_CLASS),
    ("'trimmed'", "call", "'name'", 8, 8, S_INIT), ("'charge' || n", "call", "'wallet'", 15, 15, S_PAY)]))
# Python: one file per order
PYTHON = """(SELECT o_orderkey AS k, o_custkey AS cu, o_orderstatus AS st, format('{:.2f}', o_totalprice) AS pr,
  'gen/order_' || o_orderkey || '.py' AS path FROM orders)"""
P_CLASS = "'python://' || path || '#Order' || k || '@L4'"
P_TOTAL = "'python://' || path || '::Order' || k || '#total@L7'"
P_SETTLE = "'python://' || path || '::Order' || k || '#settle_' || st || '@L11'"
P_INNER = "'python://' || path || '::Order' || k || '.settle_' || st || '#inner@L12'"
P_LOAD = "'python://' || path || '#load_' || k || '@L17'"
add("python_symbols", symbol_rows(PYTHON, "python", "path", [
    ("'Order' || k", "''", "class", "'class Order' || k || '(Status' || st || ', Row)'", "'An order of customer ' || cu || '.'", NONE, "''", 4, 14),
    ("'total'", "'Order' || k", "method", "'def total(self, rate: float = 1.0) -> float'", "'Total price: ' || pr || '.'", P_CLASS, "''", 7, 9),
    ("'settle_' || st", "'Order' || k", "method", "'async def settle_' || st || '(self)'", NONE, P_CLASS, "''", 11, 14),
    ("'inner'", "'Order' || k || '.settle_' || st", "method", "'def inner(x)'", NONE, P_SETTLE, "''", 12, 13),
    ("'load_' || k", "''", "function", "'def load_' || k || '(path)'", NONE, NONE, "''", 17, 18)]))
PYTHON_REFS = [
    ("'Status' || st", "extends", NONE, 4, 14, P_CLASS), ("'Row'", "extends", NONE, 4, 14, P_CLASS),
    ("'charge_' || cu", "call", "'book'", 9, 9, P_TOTAL), ("'helper'", "call", NONE, 13, 13, P_INNER),
    ("'inner'", "call", NONE, 14, 14, P_SETTLE), ("'capture'", "call", "'gateway'", 14, 14, P_SETTLE),
    ("'Order' || k", "call", NONE, 18, 18, P_LOAD)]
add("python_references", reference_rows("path", PYTHON, PYTHON_REFS))
SQL["parent_links"] = f"""SELECT c.path, c.symbol_key, coalesce(p.symbol_key, '-') AS parent FROM ({SQL['java_symbols']}) c
LEFT JOIN ({SQL['java_symbols']}) p ON p.path = c.path AND p.symbol_key = c.parent_key"""
SQL["java_flat_symbols"] = SQL["java_symbols"]
add("kotlin_flat_symbols", "SELECT * REPLACE (CASE WHEN name LIKE 'Shipper%' THEN 'interface' ELSE kind END AS kind) FROM ("
    + SQL["kotlin_symbols"][len(PRELUDE):] + ")")
MARK = "{\n        // ... implementation omitted ...\n    }"


def skeleton_sql(source, text):
    """Skeleton text with {placeholders} filled from SQL columns."""
    import re as _re
    parts = _re.split(r"\{(\w+)\}", text)
    terms = []
    for i, part in enumerate(parts):
        literal = part.replace("'", "''").replace("\n", "' || chr(10) || '")
        terms.append(f"CAST({part} AS VARCHAR)" if i % 2 else f"'{literal}'")
    return f"SELECT path, {' || '.join(terms)} AS skeleton FROM {source}"


add("java_skeletons", skeleton_sql(JAVA, f"""package com.acme.{{brand}};

/**
 * {{ty}} part.
 */
public class Part{{k}} extends Base{{brand}} implements {{ty}}Item {{
    private int size = {{size}};

    /** Ships the part. */
    @Override
    public Map<String, Integer> ship{{size}}(int count, String note) {MARK}

    void audit() {MARK}
}}
"""))
add("kotlin_skeletons", skeleton_sql(KOTLIN, f"""package com.acme.n{{n}}

interface Shipper{{k}} {{
    fun price{{n}}(id: String): Int
}}

// Ships goods.
class Supplier{{k}}(private val desk: Desk) : Nation{{n}}(desk), Trader {{

    @Deprecated("old")
    suspend fun offer{{k}}(part: String, count: Int): Boolean {MARK}

    fun rank(): Int = ...
}}
"""))
add("swift_skeletons", skeleton_sql(SWIFT, f"""import Foundation

/// Customer account.
public struct Customer{{k}}: Account, {{seg}} {{
    let nation = {{n}}

    public init(name: String) {MARK}

    func pay{{n}}(amount: Int) -> Bool {MARK}
}}
"""))
add("python_skeletons", skeleton_sql(PYTHON, '''"""Order {k}."""


class Order{k}(Status{st}, base.Row):
    """An order of customer {cu}."""

    def total(self, rate: float = 1.0) -> float:
        """Total price: {pr}."""
        # ... implementation omitted ...

    async def settle_{st}(self):
        # ... implementation omitted ...


def load_{k}(path):
    # ... implementation omitted ...
'''))
add("syntax_error_counts", f"SELECT path, CASE WHEN contains(path, 'Brand1/') THEN 1 ELSE 0 END AS parse_error_count FROM {JAVA}")

# Markdown: one file per document; the text has t lines and b bytes
MD = """(SELECT *, doc_id AS id, 'gen/doc_' || doc_id || '.md' AS path, strlen(source) AS sb, strlen(lang) AS lb, strlen(CAST(doc_id AS VARCHAR)) AS ib,
  len(string_split(text, chr(10))) AS t, strlen(text) AS b FROM documents)"""
S1 = "(sb + ib + 16)"
S2 = f"({S1} + lb + 30)"
S3 = f"({S2} + b + 12)"
add("markdown_sections", " UNION ALL ".join(
    f"SELECT path, {lv} AS heading_level, {h} AS heading, {hp} AS heading_path, {ct} AS content, CAST({sl} AS INTEGER) AS start_line,"
    f" CAST({el} AS INTEGER) AS end_line, CAST({sb} AS INTEGER) AS start_byte, CAST({eb} AS INTEGER) AS end_byte FROM {MD}"
    for lv, h, hp, ct, sl, el, sb, eb in [
        (1, "source", "source", "'Intro of ' || id || '.'", "1", "4", "0", S1),
        (2, "lang", "source || ' > ' || lang", "'```' || chr(10) || '# not a heading' || chr(10) || '```'", "5", "10", S1, S2),
        (3, "'Text'", "source || ' > ' || lang || ' > Text'", STRIP, "11", "13 + t", S2, S3),
        (2, "'End'", "source || ' > End'", "''", "14 + t", "14 + t", S3, f"{S3} + 7")]))
add("markdown_outlines", f"""SELECT path, '# ' || source || ' (L1-L4)' || chr(10) || '  # ' || lang || ' (L5-L10)' || chr(10) || '    # Text (L11-L' || (13 + t) || ')'
  || chr(10) || '  # End (L' || (14 + t) || '-L' || (14 + t) || ')' AS skeleton FROM {MD}""")
add("markdown_parents", " UNION ALL ".join(f"SELECT path || '#' || {line} AS doc_id, {parent} AS parent_id FROM {MD}" for line, parent in (
    ("1", NONE), ("5", "path || '#1'"), ("11", "path || '#5'"), ("(14 + t)", "path || '#1'"))))

# Files to edges: names resolve in their own file, then by receiver, then over all files
SYMBOL_SQL = symbol_rows(JAVA, "java", "path", [
    ("'Part' || k", "'com.acme.' || brand", "class", "''", NONE, NONE, "''", 6, 22),
    ("'ship' || size", "'Part' || k", "method", "''", NONE, NONE, "'(int count, String note)'", 10, 16),
    ("'audit'", "'Part' || k", "method", "''", NONE, NONE, "'()'", 18, 21)]) + " UNION ALL " + symbol_rows(PYTHON, "python", "path", [
    ("'Order' || k", "''", "class", "''", NONE, NONE, "''", 4, 14), ("'total'", "'Order' || k", "method", "''", NONE, NONE, "''", 7, 9),
    ("'settle_' || st", "'Order' || k", "method", "''", NONE, NONE, "''", 11, 14),
    ("'inner'", "'Order' || k || '.settle_' || st", "method", "''", NONE, NONE, "''", 12, 13),
    ("'load_' || k", "''", "function", "''", NONE, NONE, "''", 17, 18)])
add("parsed_call_graph", """
SELECT enclosing_key AS source_key, coalesce(f.symbol_key, g.symbol_key) AS target_key, CASE WHEN role IN ('extends', 'implements') THEN role ELSE 'calls' END AS kind,
  CASE WHEN f.n = 1 THEN 'class-scoped' WHEN g.n = 1 THEN 'probable' ELSE 'ambiguous' END AS resolution_kind,
  CASE WHEN f.n = 1 THEN 0.95 WHEN g.n = 1 THEN 0.8 ELSE 0.45 END::DOUBLE AS confidence
FROM pref LEFT JOIN (SELECT path, name, count(*) AS n, first(symbol_key) AS symbol_key FROM psym GROUP BY path, name HAVING count(*) = 1) f
   ON pref.path = f.path AND spelling = f.name
 LEFT JOIN (SELECT name, count(*) AS n, first(symbol_key ORDER BY path, start_line) AS symbol_key FROM psym GROUP BY name) g ON spelling = g.name
WHERE g.n IS NOT NULL""", f", psym AS ({SYMBOL_SQL}), pref AS ({reference_rows('path', JAVA, JAVA_REFS)} UNION ALL {reference_rows('path', PYTHON, PYTHON_REFS)})")

# --- streaming: the same answers as in batch
SQL["session_dedup_stream"] = SQL["session_dedup_window"]
add("stream_upsert", """
, up AS (SELECT path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN content || chr(10) || chr(10) || 'labelled' ELSE content END AS text FROM doc)
SELECT path, 'markdown' AS language, sha256(text) AS content_hash, strlen(text) AS size_bytes, 1::BIGINT AS sections FROM up""")
