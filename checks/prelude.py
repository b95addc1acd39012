"""DuckDB definitions of the same derived index, shared by all oracle queries."""

PRELUDE = r"""
WITH RECURSIVE
part_sym AS (
  SELECT p_partkey AS sym_id, path,
         'python://' || path || '::' || owner || '#' || name || '@L' || (p_partkey + 1) AS symbol_key,
         owner || '.' || name AS qualified_name, name, 'method' AS kind,
         'def ' || name || '(self, size: int)' AS signature,
         p_type || ' part of ' || p_brand AS docstring,
         CAST(p_partkey + 1 AS INTEGER) AS start_line, CAST(p_partkey + 1 + p_size AS INTEGER) AS end_line,
         p_partkey * 100 AS start_byte, owner, lower(p_type) AS part_type
  FROM (SELECT *, replace(p_name, ' ', '_') AS name, replace(p_brand, '#', '') AS owner,
          CASE p_type WHEN 'PROMO' THEN 'tests/' || replace(p_brand, '#', '') || '/promo_' || p_size || '.py'
               WHEN 'SMALL' THEN 'src/' || replace(p_brand, '#', '') || '/sample/small_' || p_size || '.py'
               ELSE 'src/' || replace(p_brand, '#', '') || '/' || lower(p_type) || '_' || p_size || '.py' END AS path
        FROM part)),
type_raw AS (
  SELECT -(r_regionkey::BIGINT * 5 + 1) AS sym_id, r_name AS name, 'types/Region.java' AS path, r_regionkey::BIGINT AS k,
         'interface' AS kind, 'java' AS lang, CAST(NULL AS VARCHAR) AS docstring FROM region
  UNION ALL SELECT -(n_nationkey::BIGINT * 5 + 2), n_name, 'types/Nation.java', n_nationkey::BIGINT, 'class', 'java', NULL FROM nation
  UNION ALL SELECT -(s_suppkey * 5 + 3), replace(s_name, '#', '_'), 'types/supplier/S' || s_nationkey || '.java', s_suppkey, 'class', 'java', NULL FROM supplier
  UNION ALL SELECT -(c_custkey * 5 + 4), replace(c_name, '#', '_'), 'types/customer/C' || c_nationkey || '.java', c_custkey, 'class', 'java', c_mktsegment FROM customer
  UNION ALL SELECT -(item_id * 5 + 5), coalesce(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9_]+'))[1], ''), 'bench/item_' || item_id || '.py', item_id, 'function', 'python', text FROM benchmark),
type_sym AS (
  SELECT sym_id, path, lang || '://' || path || '#' || name || '@L' || (k + 1) AS symbol_key,
         CASE lang WHEN 'java' THEN 'types.' || name ELSE name END AS qualified_name, name, kind,
         CASE lang WHEN 'java' THEN 'class ' || name ELSE 'def ' || name || '()' END AS signature, docstring,
         CAST(k + 1 AS INTEGER) AS start_line, CAST(k + 2 AS INTEGER) AS end_line, k * 64 AS start_byte
  FROM type_raw WHERE name <> ''),
sym AS (SELECT * EXCLUDE (owner, part_type) FROM part_sym UNION ALL SELECT * FROM type_sym),
occ AS (
  SELECT l_orderkey * 8 + l_linenumber AS occ_id,
         CASE WHEN l_linestatus = 'F' THEN t.path ELSE c.path END AS path,
         CASE WHEN l_linestatus <> 'F' THEN c.sym_id END AS enclosing_id, t.name AS spelling,
         CASE WHEN l_linenumber = 7 THEN 'instantiation' ELSE 'call' END AS role,
         CASE l_returnflag WHEN 'N' THEN t.owner WHEN 'R' THEN t.part_type END AS receiver,
         CAST(l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS INTEGER) AS start_line,
         CAST(l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS INTEGER) AS end_line,
         l_orderkey * 64 + l_linenumber AS start_byte
  FROM lineitem l JOIN part_sym c ON c.sym_id = l.l_partkey
       JOIN part_sym t ON t.sym_id = l.l_suppkey * 16 + l.l_linenumber
  UNION ALL SELECT -(n_nationkey::BIGINT * 5 + 2), 'types/Nation.java', -(n_nationkey::BIGINT * 5 + 2), r_name, 'implements', NULL,
         CAST(n_nationkey + 1 AS INTEGER), CAST(n_nationkey + 1 AS INTEGER), n_nationkey::BIGINT * 64
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT -(s_suppkey * 5 + 3), 'types/supplier/S' || s_nationkey || '.java', -(s_suppkey * 5 + 3), n_name, 'extends', NULL,
         CAST(s_suppkey + 1 AS INTEGER), CAST(s_suppkey + 1 AS INTEGER), s_suppkey * 64
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT -(c_custkey * 5 + 4), 'types/customer/C' || c_nationkey || '.java', -(c_custkey * 5 + 4), n_name, 'extends', NULL,
         CAST(c_custkey + 1 AS INTEGER), CAST(c_custkey + 1 AS INTEGER), c_custkey * 64
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT -(event_id * 5 + 5), 'tests/events/user_' || user_id || '.py', NULL, event_type, 'call', 'props', 1, 1, event_id * 64
  FROM events),
by_name AS (
  SELECT name AS spelling, count(*) AS repo_n, first(sym_id ORDER BY path, start_byte, symbol_key) AS repo_sym
  FROM sym GROUP BY name),
by_file AS (
  SELECT path, name AS spelling, count(*) AS file_n, first(sym_id ORDER BY path, start_byte, symbol_key) AS file_sym
  FROM sym GROUP BY path, name),
by_receiver AS (
  SELECT spelling, receiver, count(*) AS recv_n, first(sym_id ORDER BY path, start_byte, symbol_key) AS recv_sym
  FROM (SELECT DISTINCT spelling, receiver FROM occ WHERE receiver <> '') JOIN sym ON name = spelling
  WHERE qualified_name ILIKE '%' || receiver || '%' OR symbol_key ILIKE '%' || receiver || '%'
  GROUP BY spelling, receiver),
res AS (
  SELECT occ.*,
         CASE WHEN file_n = 1 THEN file_sym WHEN recv_n = 1 THEN recv_sym ELSE repo_sym END AS target_id,
         CASE WHEN file_n = 1 THEN 'class-scoped' WHEN recv_n = 1 THEN 'import-scoped' WHEN repo_n = 1 THEN 'probable'
              WHEN repo_n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution_kind,
         CASE WHEN file_n = 1 THEN 0.95 WHEN recv_n = 1 THEN 0.9 WHEN repo_n = 1 THEN 0.8
              WHEN repo_n > 1 THEN 0.45 END::DOUBLE AS confidence
  FROM occ LEFT JOIN by_name USING (spelling) LEFT JOIN by_file USING (path, spelling)
       LEFT JOIN by_receiver USING (spelling, receiver)),
edge AS (
  SELECT enclosing_id AS source_id, target_id, occ_id,
         CASE WHEN role IN ('implements', 'extends') THEN role ELSE 'calls' END AS kind, resolution_kind, confidence
  FROM res WHERE target_id IS NOT NULL AND enclosing_id IS NOT NULL),
call_pair AS (SELECT DISTINCT source_id, target_id FROM edge WHERE kind = 'calls'),
type_pair AS (SELECT DISTINCT source_id, target_id FROM edge WHERE kind IN ('implements', 'extends')),
any_pair AS (
  SELECT source_id AS a, target_id AS b FROM edge UNION SELECT target_id, source_id FROM edge),
doc AS (
  SELECT doc_id, 'docs/' || source || '/' || lang || '_' || doc_id || '.md' AS path,
         CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS heading_level,
         source AS heading, lang || ' > ' || source AS heading_path, text AS content, 1 AS start_line,
         CAST(len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS INTEGER) AS end_line
  FROM documents),
file AS (
  SELECT path, 'markdown' AS language, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM doc
  UNION ALL SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'java' END, sha256(path), strlen(path)
  FROM (SELECT DISTINCT path FROM sym)),
sdoc AS (
  SELECT 'symbol' AS entity_type, CAST(sym_id AS VARCHAR) AS entity_id, coalesce(qualified_name, name) AS title, path,
         signature || chr(10) || coalesce(docstring, '') AS body FROM sym
  UNION ALL SELECT 'occurrence', CAST(occ_id AS VARCHAR), spelling, path, coalesce(receiver, '') FROM occ
  UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), heading || ' (' || heading_path || ')', path, content FROM doc),
sword AS (
  SELECT *, list_filter(string_split_regex(strip_accents(lower(title || ' ' || path || ' ' || body)), '[^\p{L}\p{N}]+'),
                        lambda w: w <> '') AS words FROM sdoc)
"""


def bm25(tokens, prefix=None):
    """CTEs ``hit`` (scored matches) for a fixed list of query words."""
    tf = ", ".join(f"len(list_filter(words, lambda w: starts_with(w, '{t}'))) AS tf{i}" for i, t in enumerate(tokens))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(tokens)))
    idf = [f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
           for i in range(len(tokens))]
    score = " + ".join(f"{idf[i]} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(tokens)))
    where = " OR ".join(f"tf{i} > 0" for i in range(len(tokens)))
    scope = f" AND path ILIKE '{prefix}%'" if prefix else ""
    return (f", cnt AS (SELECT * EXCLUDE (words), len(words) AS dl, {tf} FROM sword),"
            f" stat AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM cnt),"
            f" hit AS (SELECT entity_type, entity_id, title, path, body, -({score}) AS bm25 FROM cnt, stat WHERE ({where}){scope})")
