"""Steps that must not move or hold more rows than they need."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import build, graph, resolve, sections, skew, statements, syntax
from codeloom.operators.lineage import materialize

OCCURRENCE = "occ_id long, path string, enclosing_id long, spelling string, role string, receiver string"
SYMBOL = "sym_id long, path string, name string, start_byte long, symbol_key string, qualified_name string"


@pytest.fixture
def no_broadcast(spark):
    """Tables too large for Spark's own threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_right_rows_do_not_move_the_left(spark, no_broadcast):
    left = materialize(spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k")))
    right = materialize(spark.createDataFrame([("k1", 1), ("k2", 2), ("k9", 9)], "k string, v int"))
    few = skew.salted_left_join(left, right, "k", floor=20)
    assert "BroadcastHashJoin" in plan_of(few) and "SortMergeJoin" not in plan_of(few)
    counts = left.groupBy("k").agg(F.count("*").alias("_n"))
    salted = skew.salted_left_join(left, right, "k", floor=20, counts=counts, few=0)
    assert "BroadcastHashJoin" not in plan_of(salted) or "SortMergeJoin" in plan_of(salted)
    expected = sorted(left.join(right, "k", "left").select("id", "v").collect())
    assert sorted(few.select("id", "v").collect()) == expected == sorted(salted.select("id", "v").collect())


def test_resolution_moves_occurrences_for_names_of_a_file_only(spark, no_broadcast):
    symbols = [(1, "a.py", "f", 0, "k1", "A.f"), (2, "b.py", "f", 0, "k2", "B.f"), (3, "b.py", "g", 5, "k3", "B.g"), (4, "b.py", "f", 9, "k4", "C.f"),
               (5, "c.py", None, 0, "k5", "x")]
    occurrences = [(1, "a.py", None, "f", "call", None), (2, "z.py", 1, "f", "call", "B"), (3, "z.py", 1, "f", "call", ""), (4, "z.py", 1, "g", "call", "q"),
                   (5, "z.py", 1, "none", "call", None), (6, "b.py", 1, "f", "call", "C"), (7, "z.py", 1, None, "call", "C"), (8, None, 1, "g", "call", None),
                   (9, "z.py", 1, "f", "call", "zz")]
    rows = resolve.resolve_occurrences(materialize(spark.createDataFrame(occurrences, OCCURRENCE)), spark.createDataFrame(symbols, SYMBOL))
    assert plan_of(rows).count("SortMergeJoin") <= 1
    got = {r["occ_id"]: (r["target_id"], r["resolution_kind"], r["confidence"]) for r in rows.collect()}
    kinds = {k: (t, got[k][1]) for k, (t, _, _) in got.items()}
    assert [kinds[i][0] for i in range(1, 10)] == [1, 2, 1, 3, None, 4, None, 3, 1]
    from codeloom import constants as C
    assert [got[i][1:] for i in (1, 2, 3, 4, 5)] == [C.CLASS_SCOPED, C.IMPORT_SCOPED, C.AMBIGUOUS, C.PROBABLE, (C.UNRESOLVED, None)]


def test_walks_hold_each_node_once(spark):
    pairs = [(1, 2), (1, 2), (2, 3), (3, 1), (2, 1), (3, 4), (4, 2), (1, 4)]
    edges = materialize(spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source_id long, target_id long, kind string"))
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "sym_id long")
    walk = graph._bounded_walk(lambda f: graph._steps(edges, ["calls"], f), seeds, 4)
    assert sorted((r["node"], r["depth"], r["via"]) for r in walk.collect()) == [(1, 2, 2), (2, 1, 1), (3, 2, 2), (4, 1, 1)]
    assert sorted(tuple(r) for r in graph.upstream_callers(edges, seeds, 3).select("node", "depth", "via").collect()) == [(1, 2, 2), (2, 1, 1), (3, 1, 1), (4, 2, 2)]


DOCUMENT = "entity_type string, entity_id string, title string, path string, body string, kind string"


@pytest.fixture
def small_parts():
    from codeloom.operators import postings
    before = postings.PART_BYTES
    postings.PART_BYTES = 50_000
    yield postings
    postings.PART_BYTES = before


def test_long_documents_do_not_meet_in_one_task(spark, small_parts):
    postings = small_parts
    rows = spark.range(4000).select(
        F.lit("doc").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit("t").alias("title"), F.concat(F.lit("p/"), F.col("id") % 7).alias("path"),
        F.when(F.col("id") % 100 == 0, F.repeat(F.lit("word other "), 1000)).otherwise("word").alias("body"), F.lit(None).cast("string").alias("kind"))
    index = postings.build(rows)
    held = index.documents.groupBy(F.shiftright("number", 33).alias("part")).agg(F.sum(F.octet_length("body")).alias("bytes")).collect()
    assert max(r["bytes"] for r in held) < 4 * postings.PART_BYTES   # of 444,000 bytes
    assert index.documents.select("number").distinct().count() == 4000
    tfs = index.blocks.where("term = 'word'").select(F.explode(F.arrays_zip("numbers", "tfs", "sizes")).alias("r")).select("r.*")
    assert sorted((r[0], r[1]) for r in tfs.groupBy("tfs").count().collect()) == [(1, 3960), (1000, 40)]
    assert tfs.select("numbers").distinct().count() == 4000


def test_only_what_can_be_shown_is_read(spark, small_parts):
    """Very many matches of the same score: the first in order, without the others' documents."""
    postings = small_parts
    from codeloom.operators import search
    rows = spark.range(30000).select(
        F.lit("doc").alias("entity_type"), F.format_string("%05d", F.col("id")).alias("entity_id"), F.lit("same").alias("title"),
        F.format_string("p%05d", (F.col("id") * 7919) % 30000).alias("path"), F.lit("b").alias("body"), F.lit(None).cast("string").alias("kind"))
    index = postings.build(rows)
    order = [F.round("bm25", 9), *search.TIE_ORDER]
    query = postings.Query(index, ["same"])
    for keep in (None, F.col("entity_id") > "20000"):
        best = [r.path for r in query.best(5, keep, order).orderBy(*order).collect()]
        wanted = rows if keep is None else rows.where(keep)
        assert best == [r.path for r in wanted.orderBy("path").limit(5).collect()]
        parts = index.documents.select(F.shiftright("number", 33)).distinct().count()
        assert query._leading(query.ranges(), keep, 5, 0.0).count() <= 5 * parts


def test_python_nodes_come_in_small_frames():
    import pandas as pd
    from codeloom.sources import python_nodes
    batch = pd.DataFrame({"path": [f"f{i}.py" for i in range(3000)], "content": [b"class A(B):\n    def f(self):\n        return g(h(1))\n"] * 2999 + [b"def ("]})
    frames = list(python_nodes.read_nodes([batch, batch]))
    assert max(map(len, frames)) < 2 * python_nodes.ROWS
    assert sum(map(len, frames)) == 2 * (2999 * 4 + 1) and sum(f["path"].nunique() for f in frames) >= 6000


def test_call_graph_writes_what_edges_read(spark, monkeypatch):
    from codeloom.plans import catalog
    seen = {}
    kept = catalog.build.written
    monkeypatch.setattr(catalog.build, "written", lambda tables: seen.update(tables) or kept(tables))
    edges = catalog.QUERIES["parsed_call_graph"](spark, "/root/testdata/sf0.001")
    assert not {"signature", "docstring", "parent_id"} & set(seen["symbols"].columns) and "start_byte" not in seen["occurrences"].columns
    assert edges.count() > 0


def test_statements_need_no_row_per_token_and_shapes_are_matched_once(spark):
    files = spark.createDataFrame([("A.java", "java", bytearray(b"class A { void f() { g(1); } }"))], "path string, language string, content binary")
    plan = plan_of(syntax.declarations(syntax.statements(files, syntax.source_text("content"))))
    assert "Window" not in plan and "Sort" not in plan and "explode(regexp_extract_all" not in plan
    assert all("regexp_extract" not in line for line in plan.splitlines() if line.strip(" +-*()0123456789").startswith("Filter"))


def test_files_are_placed_in_bounded_pieces(monkeypatch):
    import re
    import pyarrow as pa
    texts = ["/* a */ class A { // b\n  int f(int x) { return this.g(x).h(); } }"] * 7 + [None, "", "fun `a b`() = c { d }", "}} x ( ["]
    cut = [None if t is None else re.findall(r"/\*.*?\*/|//[^\n]*|`[^`]*`|\w+|\s+|.", t) for t in texts]
    batch = pa.RecordBatch.from_pydict({
        "path": [f"f{i}" for i in range(len(texts))], "language": ["java"] * 9 + ["kotlin", "swift"],
        "toks": pa.array(cut, pa.list_(pa.string())), "letters": [""] * len(texts), "digits": [None] * len(texts)})
    whole = pa.Table.from_batches(statements._placed([batch])).to_pylist()
    monkeypatch.setattr(statements, "TOKENS", 40)
    pieces = list(statements._placed([batch]))
    assert len(pieces) > 5 and sorted(map(repr, pa.Table.from_batches(pieces).to_pylist())) == sorted(map(repr, whole))
    assert {r["shape"] for r in whole if r["path"] == "f6"} == {"class A { }", "int f ( ) { }", "int x", "return this . g ( ) . h ( ) ;", "x"}
    assert next(r for r in whole if r["shape"] == "class A { }")["comments"] == ["/* a */"]


def test_texts_of_sections_move_once(spark, no_broadcast):
    """Two exchanges by path, one of files with headings and one of files without; links between sections need none."""
    rows = [("a.md", "markdown", bytearray(b"# A\n## B\n```\n# no\n```\n## C\n")), ("b.md", "markdown", bytearray(b"```\n# no\n```\n"))]
    files = materialize(spark.createDataFrame(rows, "path string, language string, content binary"))
    assert plan_of(sections.parse(files)).count("Exchange") == 2 and "Join" not in plan_of(sections.parse(files))
    docs = build.build_index(build.with_hash(files).selectExpr("*", "0L as size_bytes", "0L as mtime_ns"))["docs"]
    assert plan_of(docs).count("Exchange") <= 3
    found = {r.heading: r for r in docs.collect()}
    assert set(found) == {"A", "B", "C", "b.md"} and found["B"].parent_id == found["C"].parent_id == found["A"].doc_id
    assert found["A"].parent_id is None and found["b.md"].parent_id is None


NESTED = b'''class A(B.c, D):
    """Doc."""

    def f(self):
        def g(x):
            return h(x)
        return g(i.j())


k()
'''


def test_python_rows_need_no_rows_of_others(spark, no_broadcast):
    """Keys of what is around a definition or a call come with it: symbols and references are read without a join, and each text moves once."""
    from codeloom.operators import pysyntax
    files = materialize(spark.createDataFrame([("a.py", "python", bytearray(NESTED)), ("b.py", "python", bytearray(b"def ("))], "path string, language string, content binary"))
    symbols, references, errors = pysyntax.parse(files)
    assert not any(word in plan_of(df) for df in (symbols, references) for word in ("Join", "Exchange"))
    keys = {"A": "python://a.py#A@L1", "f": "python://a.py::A#f@L4", "g": "python://a.py::A.f#g@L5"}
    assert {r["name"]: (r["symbol_key"], r["parent_key"]) for r in symbols.collect()} == {"A": (keys["A"], None), "f": (keys["f"], keys["A"]), "g": (keys["g"], keys["f"])}
    assert {(r["spelling"], r["receiver"], r["enclosing_key"]) for r in references.collect()} == {
        ("c", None, keys["A"]), ("D", None, keys["A"]), ("h", None, keys["g"]), ("g", None, keys["f"]), ("j", "i", keys["f"]), ("k", None, None)}
    assert {r["path"]: r["parse_error_count"] for r in errors.collect()} == {"a.py": 0, "b.py": 1}


def test_outermost_bodies_take_one_sort_of_bodies(spark, no_broadcast):
    from codeloom.operators import pysyntax, skeleton
    files = materialize(spark.createDataFrame([("a.py", "python", bytearray(NESTED))], "path string, language string, content binary"))
    cuts = skeleton.redactions(files, pysyntax.parse(files)[0])
    assert plan_of(cuts).count("Window") == 1 and "Union" not in plan_of(cuts)
    assert [r["name"] for r in cuts.collect()] == ["f"]
    same_start = spark.createDataFrame([("p", "java", n, None, n, s, e, s, e, "method") for n, s, e in (("a", 0, 9), ("b", 0, 5), ("c", 5, 8), ("d", 9, 12), ("e", 10, 11))],
                                       "path string, language string, name string, docstring string, symbol_key string, start_byte int, end_byte int, body_start_byte int, body_end_byte int, kind string")
    whole = spark.createDataFrame([("p", bytearray(b"{" * 12))], "path string, content binary")
    assert sorted(r["name"] for r in skeleton.redactions(whole, same_start).collect()) == ["a", "b", "d"]


def test_written_index_is_packed(spark):
    """Rising numbers, ids and texts that share a beginning take a fraction of their plain size in written tables, and of the postings on their way."""
    import pyarrow.parquet as pq
    from codeloom.operators import postings
    rows = spark.range(60000).select(
        F.lit("doc").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit("same").alias("title"),
        F.format_string("some/long/folder/p%06d", F.col("id")).alias("path"), F.lit("b").alias("body"), F.lit(None).cast("string").alias("kind"))
    index = postings.build(rows)

    def bytes_of(df, column):
        parts = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in df.inputFiles()]
        chunks = [m.row_group(g).column(c) for m in parts for g in range(m.num_row_groups) for c in range(m.num_columns)]
        return sum(c.total_compressed_size for c in chunks if c.path_in_schema.split(".")[0] == column)
    postings_n = index.blocks.select(F.sum(F.size("numbers"))).first()[0]
    assert bytes_of(index.blocks, "numbers") < 3 * postings_n   # 8 each otherwise
    assert bytes_of(index.documents, "number") < 60000 and bytes_of(index.documents, "words") < 20 * 60000
    assert "offsets array<short>" in postings.BLOCKS
    got = index.blocks.where("term = 'same'").select(F.explode("numbers").alias("n")).join(index.documents, F.col("n") == F.col("number")).count()
    assert got == 60000
