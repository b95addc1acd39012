"""The inverted index against plain counting, and what it leaves unread."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.operators import postings, search

ROWS = "entity_type string, entity_id string, title string, path string, body string, kind string"


def plain_scores(rows, tokens):
    """bm25 (lower is better) of every row with a word that begins with a token."""
    words = [[w for w in "".join(c.lower() if c.isalnum() else " " for c in f"{r[2]} {r[3]} {r[4]}").split()] for r in rows]
    mean = sum(map(len, words)) / len(words)
    tf = [[sum(w.startswith(t) for w in own) for t in tokens] for own in words]
    idf = []
    for i in range(len(tokens)):
        df = sum(t[i] > 0 for t in tf)
        value = math.log((len(rows) - df + 0.5) / (df + 0.5))
        idf.append(value if value > 0 else C.BM25_IDF_FLOOR)
    return {r[1]: -sum(idf[i] * t[i] * (C.BM25_K1 + 1) / (t[i] + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * len(own) / mean)) for i in range(len(tokens)))
            for r, own, t in zip(rows, words, tf) if any(t)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = ["gear", "gears", "gearbox", "axle", "bolt", "nut", "plate", "ring"] + [f"w{i}" for i in range(200)]
    return [(rng.choice(["symbol", "doc", "occurrence"]), str(i), rng.choice(pool), f"p{i % 17}/f.py", " ".join(rng.choices(pool, k=rng.randint(1, 60))), rng.choice(["class", "method", None]))
            for i in range(400)]


@pytest.fixture(scope="module")
def index(spark, rows):
    size = postings.RANGE
    postings.RANGE = 8
    yield postings.build(spark.createDataFrame(rows, ROWS))
    postings.RANGE = size


@pytest.mark.parametrize("tokens", [["gear"], ["axle", "bolt"], ["w1", "gear", "ring"], ["absent"], ["gear", "absent"]])
def test_scores_and_best(spark, rows, index, tokens):
    want = plain_scores(rows, tokens)
    got = {r.entity_id: r.bm25 for r in search.bm25_matches(index, tokens).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    order = [F.round("bm25", 9), *search.TIE_ORDER]
    by_id = {r[1]: r for r in rows}

    def key(i):
        return round(want[i], 9), by_id[i][3], by_id[i][0], by_id[i][1]
    for keep, chosen in ((None, list(want)), (F.col("kind") == "class", [i for i in want if by_id[i][5] == "class"])):
        best = [r.entity_id for r in postings.Query(index, tokens).best(7, keep, order).orderBy(*order).collect()]
        assert best == sorted(chosen, key=key)[:7]


def test_ranges_that_cannot_reach_the_top_are_not_scored(index, rows):
    postings.Query(index, ["gear"]).best(3, None, [F.round("bm25", 9), *search.TIE_ORDER]).collect()
    scored, holding = index.scored
    assert scored < 0.7 * holding


def test_blocks_are_found_by_pushed_prefixes(index):
    plan = postings.blocks_of(index, "gear")._jdf.queryExecution().explainString(index.documents.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(term,gear)" in plan
    query = postings.Query(index, ["gear"])
    assert "words" not in query.scores()._jdf.queryExecution().toString()   # documents aren't read for scores


def test_a_phrase_counts_overlapping_occurrences(spark):
    rows = [("doc", "1", "a a a ab", "p", "", None), ("doc", "2", "a b a", "q", "", None)]
    index = postings.build(spark.createDataFrame(rows, ROWS))
    held = {r.numbers[0]: r.tfs[0] for r in postings.blocks_of(index, "a a").collect()}
    assert list(held.values()) == [3]


def test_an_index_is_kept_and_loaded(spark, rows, tmp_path):
    folder = str(tmp_path / "text")
    assert postings.load(spark, folder) is None
    postings.build(spark.createDataFrame(rows[:50], ROWS), folder)
    loaded = postings.load(spark, folder)
    assert {r.entity_id for r in search.bm25_matches(loaded, ["gear"]).collect()} == set(plain_scores(rows[:50], ["gear"]))


def test_no_documents(spark):
    empty = spark.createDataFrame([], ROWS)
    assert search.search_text(empty, "gear").count() == 0 and search.bm25_matches(empty, ["gear"]).count() == 0


def test_a_kind_below_the_first_rows_of_both_lists_is_found(spark):
    """Sixty classes and one method of one name."""
    symbols = [(str(i), f"p{i:02d}.py", f"k{i}", "m.gear" if i < 60 else "gear", "gear", "class" if i < 60 else "method", "sig gear", None, 1, 2, 1) for i in range(61)]
    frame = spark.createDataFrame(symbols, "sym_id string, path string, symbol_key string, qualified_name string, name string, kind string, signature string, docstring string, "
                                           "start_line int, end_line int, start_byte int")
    nothing = spark.createDataFrame([], "occ_id string, spelling string, path string, receiver string")
    sections = spark.createDataFrame([], "doc_id string, heading string, heading_path array<string>, path string, content string")
    documents = search.search_documents(frame, nothing, sections)
    edges = spark.createDataFrame([], "source_id string, target_id string, kind string")
    files = spark.createDataFrame([], "path string, language string, size_bytes long")
    for kind, n in (("method", 1), ("class", 8)):
        found = search.search(frame, documents, edges, files, "gear", kinds=[kind], limit=8).collect()
        assert [r.symbol_kind for r in found] == [kind] * n
