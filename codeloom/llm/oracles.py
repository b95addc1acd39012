"""DuckDB SQL with the rows of those queries that SQL can express."""

# CRC-32: the table of one step for each byte, and the CRC of a string's bytes
STEP = "list_reduce(list_prepend(b, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
CRC = f"crc_table AS (SELECT list({STEP} ORDER BY b) AS steps FROM range(256) AS r(b))"


def crc32(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1])), 4294967295)"


def edit(way: str, cost: str, letter: str, line: str = "''") -> str:
    """A way (cost in 9 digits, audit, chr(1), repaired lines) after one more edit; null stays null."""
    return (f"lpad((left({way}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({way}, 10, strpos({way}, chr(1)) - 10) || '{letter}' || chr(1) "
            f"|| substr({way}, strpos({way}, chr(1)) + 1) || {line}")


# ways into four states: nothing yet (n), after system (s), user (u) and assistant (a); inserts come before the edit of a row
INSERTS = f"""SELECT *, least(a1, {edit('u1', '5', 'I', "'assistant:' || chr(10)")}) AS a2, u1 AS u2
      FROM (SELECT *, a AS a1, least(u, {edit('n', '5', 'I', "'user:' || chr(10)")}, {edit('s', '5', 'I', "'user:' || chr(10)")},
                                     {edit('a', '5', 'I', "'user:' || chr(10)")}) AS u1 FROM ways_now)"""
STAYS = "fault NOT IN ('b', 'd')"
PRICE = "(CASE WHEN fault = 't' THEN 5 ELSE 0 END)"
OWN = "role || ':' || text || chr(10)"
REPAIR = r"""
WITH RECURSIVE """ + CRC + r""",
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
          FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, """ + crc32("name") + r""" % 20 AS kind FROM named, crc_table),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
marked AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
row AS (SELECT *, CASE WHEN final = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE ' ' END AS fault FROM marked),
way(conv_id, i, n, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000' || chr(1), NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM dam
  UNION ALL
  SELECT conv_id, i + 1,
         """ + edit("n", "2", "D") + r""",
         least(""" + edit("s", "2", "D") + f""", CASE WHEN {STAYS} AND role LIKE 's%' THEN {edit('n', PRICE, 'K', OWN)} END),
         least({edit('u2', '2', 'D')}, CASE WHEN {STAYS} AND role LIKE 'u%' THEN {edit('least(n, s, a2)', PRICE, 'K', OWN)} END,
               CASE WHEN {STAYS} THEN {edit('least(n, s, a2)', PRICE + ' + 1', 'R', "'user:' || text || chr(10)")} END),
         least({edit('a2', '2', 'D')}, CASE WHEN {STAYS} AND role LIKE 'a%' THEN {edit('u2', PRICE, 'K', OWN)} END,
               CASE WHEN {STAYS} THEN {edit('u2', PRICE + ' + 1', 'R', "'assistant:' || text || chr(10)")} END)
  FROM ({INSERTS.replace('ways_now', '(SELECT w.*, r.role, r.text, r.fault FROM way w JOIN row r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1)')})),
last AS (SELECT w.conv_id, least(n, a2) AS best FROM ({INSERTS.replace('ways_now', 'way')}) w
         JOIN (SELECT conv_id, max(i) AS i FROM row GROUP BY 1) m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.i = m.i),
tally AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                 count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM row GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost,
       coalesce(substr(best, 10, strpos(best, chr(1)) - 10), '') AS audit,
       sha256(coalesce(substr(best, strpos(best, chr(1)) + 1, greatest(length(best) - strpos(best, chr(1)) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN tally t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN last l ON o.conv_id IS NOT DISTINCT FROM l.conv_id"""

SQL = {
    "op1_decontaminate": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
        FROM item, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM doc, lengths, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, occ.n, i, item_id FROM occ JOIN win ON occ.gram = win.gram AND occ.n = win.n),
word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS r(k) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)""",

    "op2_ngram_jaccard": r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS gram FROM doc, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM gram a JOIN gram b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id""",

    "op5_url_filters": r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
link AS (SELECT url, unnest([regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                             regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
                             regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[\d.\s]*[;,]?\s*url\s*=\s*''?([^"''\s>]+)', 1)]) AS target
         FROM pages),
pair AS (SELECT substr(url, strpos(url, '://') + 3) AS a, substr(target, strpos(target, '://') + 3) AS b FROM link WHERE target LIKE '%://%'),
keyed AS (SELECT lower(regexp_extract(a, '^[^/?#]*')) || regexp_extract(a, '^[^/?#]*([^#]*)', 1) AS a,
                 lower(regexp_extract(b, '^[^/?#]*')) || regexp_extract(b, '^[^/?#]*([^#]*)', 1) AS b FROM pair),
edge AS (SELECT a, b FROM keyed WHERE a <> b UNION SELECT b, a FROM keyed WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
node AS (SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host,
                regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
                lower(regexp_extract(rest, '^[^/?#]*')) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS key FROM page),
rule(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
alias AS (SELECT r.a AS key, r.b, regexp_extract(r.b, '^[^/?#]*') AS host, regexp_extract(r.b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach r),
fit AS (SELECT key, b, arg_max(verdict, length(h) + length(p)) AS verdict FROM alias JOIN rule
        ON (host = h OR host LIKE '%.' || h) AND path LIKE p || '%' GROUP BY 1, 2),
by_alias AS (SELECT key, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM fit GROUP BY 1),
own AS (SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS verdict
        FROM node JOIN rule ON (host = h OR host LIKE '%.' || h) AND path LIKE p || '%' GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(own.verdict, by_alias.verdict, 'allow') AS verdict
FROM node LEFT JOIN own USING (page_id) LEFT JOIN by_alias USING (key)""",

    "op9_embedding_dedup": r"""
WITH RECURSIVE vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT * FROM vec WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                               AND list_max(list_transform(v, lambda x: abs(x))) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, e.b FROM reach r JOIN link e ON r.b = e.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM vec LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id""",

    "op11_conversation_repair": REPAIR,

    "op13_resampling": r"""
WITH """ + CRC + r""",
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS w FROM doc),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
crc AS (SELECT w, """ + crc32("w") + r""" % 10000 AS bucket FROM (SELECT w FROM word UNION SELECT w FROM goal), crc_table),
s AS (SELECT bucket, count(*) AS n FROM word JOIN crc USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN crc USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
                                      / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS gain
         FROM s FULL JOIN t USING (bucket)),
weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM word JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
           FROM doc LEFT JOIN weight USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)""",
}
