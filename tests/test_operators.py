"""Operators against brute force on small random inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, indexing, lookup, resolve, search, session, skew, spans, usages


def like(hay, needle):
    pattern = "".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in needle.lower())
    return re.search(pattern, hay.lower(), re.S) is not None


@pytest.fixture(scope="module")
def code(spark):
    rng = random.Random(7)
    names, owners = ["get", "get", "get", "put", "close", "open_it"], ["User", "Order_Repo", "OrderXRepo", "Cart"]
    symbols = []
    for i in range(60):
        name, owner, path = rng.choice(names), rng.choice(owners), f"src/m{rng.randrange(9)}.py"
        symbols.append((f"s{i:02d}", path, f"python://{path}::{owner}#{name}@L{i}", f"{owner}.{name}", name, "method", i * 10))
    receivers = [None, "", "user", "order_repo", "cart", "o%repo", "m1", "absent", "self"]
    occurrences = [(f"o{i:03d}", f"src/m{rng.randrange(9)}.py", rng.choice(symbols)[0] if rng.random() < .8 else None,
                    rng.choice(names + ["unknown"]), rng.choice(["call", "call", "extends"]), rng.choice(receivers), i, i * 5)
                   for i in range(300)]
    return (symbols, occurrences,
            spark.createDataFrame(symbols, "sym_id string, path string, symbol_key string, qualified_name string, name string, kind string, start_byte int"),
            spark.createDataFrame(occurrences, "occ_id string, path string, enclosing_id string, spelling string, role string, receiver string, start_line int, start_byte int"))


def expected_resolution(symbols, occ):
    ordered = sorted(symbols, key=lambda s: (s[1], s[6], s[2]))
    named = [s for s in ordered if s[4] == occ[3]]
    same = [s for s in named if s[1] == occ[1]]
    if len(same) == 1:
        return same[0][0], "class-scoped", 0.95
    if occ[5]:
        hits = [s for s in named if like(s[3], occ[5]) or like(s[2], occ[5])]
        if len(hits) == 1:
            return hits[0][0], "import-scoped", 0.90
    if not named:
        return None, "unresolved", None
    return (named[0][0], "probable", 0.80) if len(named) == 1 else (named[0][0], "ambiguous", 0.45)


@pytest.mark.parametrize("direct", [256, 0, 5])
def test_resolution(code, direct):
    symbols, occurrences, symbol_frame, occurrence_frame = code
    rows = resolve.resolve_occurrences(occurrence_frame, symbol_frame, direct).collect()
    got = {r["occ_id"]: (r["target_id"], r["resolution_kind"], r["confidence"]) for r in rows}
    assert got == {o[0]: expected_resolution(symbols, o) for o in occurrences}


def test_salted_join_equals_plain(code, spark):
    _, _, symbol_frame, occurrence_frame = code
    right = symbol_frame.groupBy(F.col("name").alias("spelling")).agg(F.count("*").alias("n"))
    salted = skew.salted_left_join(occurrence_frame, right, "spelling", floor=20)
    plain = occurrence_frame.join(right, "spelling", "left")
    assert sorted(map(tuple, salted.select("occ_id", "n").collect())) == sorted(map(tuple, plain.select("occ_id", "n").collect()))


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(40), rng.randrange(40), rng.choice(["calls", "calls", "extends"])) for _ in range(90)}
    return rows, spark.createDataFrame(sorted(rows), "source_id int, target_id int, kind string")


def walk(step, seeds, depth):
    """(node, depth) rows of all walks, seeds not counted as reached."""
    found, frontier = {}, set(seeds)
    for d in range(1, depth + 1):
        frontier = {b for a in frontier for b in step(a)}
        for node in frontier:
            found.setdefault(node, d)
    return found


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_call_walks(spark, edges, depth):
    rows, frame = edges
    seeds = spark.createDataFrame([(1,), (2,)], "id int")
    calls = [(s, t) for s, t, k in rows if k == "calls"]
    up = {r["node"]: r["depth"] for r in graph.upstream_callers(frame, seeds, depth).collect()}
    assert up == walk(lambda n: [s for s, t in calls if t == n], [1, 2], depth)
    down = {r["node"]: r["depth"] for r in graph.downstream_callees(frame, seeds, depth).collect()}
    assert down == walk(lambda n: [t for s, t in calls if s == n], [1, 2], depth)


def test_proximity(spark, edges):
    rows, frame = edges
    near = {r["node"]: r["depth"] for r in graph.graph_proximity(frame, spark.createDataFrame([(1,), (None,)], "id int")).collect()}
    expected = walk(lambda n: [t for s, t, _ in rows if s == n] + [s for s, t, _ in rows if t == n], [1], 3)
    assert near == {**expected, 1: 0}


def test_subtypes_diamond_and_cycle(spark):
    def run(pairs, seed):
        frame = spark.createDataFrame([(s, t, "extends") for s, t in pairs], "source_id string, target_id string, kind string")
        found = graph.subtypes(frame, spark.createDataFrame([(seed,)], "id string"))
        return sorted((r["node"], r["depth"]) for r in found.collect())
    assert run([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c")], "a") == [("b", 1), ("c", 1), ("c", 2), ("d", 2), ("d", 3)]
    assert run([("b", "a"), ("a", "b")], "a") == [("a", 2), ("b", 1)]
    assert run([("a", "a")], "a") == [("a", 1)]
    assert run([("b", "a")], "b") == []


def test_enclosing(spark):
    intervals = [("f", 0, 100, "A"), ("f", 10, 50, "B"), ("f", 20, 30, "C"), ("f", 60, 90, "D"), ("g", 5, 9, "E")]
    frame = spark.createDataFrame(intervals, "path string, start_byte int, end_byte int, key string")
    points = spark.createDataFrame([("f", p) for p in range(0, 120, 5)] + [("g", 3), ("g", 5), ("g", 9)], "path string, start_byte int")
    got = {(r["path"], r["start_byte"]): r["owner"] for r in spans.enclosing(points, frame, "owner", F.col("key")).collect()}
    for (path, at), owner in got.items():
        inside = [i for i in intervals if i[0] == path and i[1] <= at < i[2]]
        assert owner == (max(inside, key=lambda i: i[1])[3] if inside else None)
    parents = {r["key"]: r["parent"] for r in spans.enclosing(frame, frame, "parent", F.col("key"), outside_own=True).collect()}
    assert parents == {"A": None, "B": "A", "C": "B", "D": "A", "E": None}


def test_session_rules(spark):
    rng = random.Random(11)
    rows = []
    for s in range(30):
        turn = 1
        for seq in range(40):
            turn += rng.random() < .4
            rows.append((s, seq, turn, rng.choice("abc"), rng.random() < .2))
    expected, emitted = {}, {}
    for s, seq, turn, key, force in rows:
        last = emitted.get((s, key))
        if last is not None and not force and last < turn:
            expected[s, seq] = last
        else:
            expected[s, seq] = None
            emitted[s, key] = turn
    frame = spark.createDataFrame(rows, "session_id int, seq int, turn int, key string, force boolean")
    old = session.TURN_BLOCK
    session.TURN_BLOCK = 3
    try:
        got = {(r["session_id"], r["seq"]): r["source_turn"] for r in session.deduplicate(frame).collect()}
    finally:
        session.TURN_BLOCK = old
    assert got == expected


def test_doc_parents_prefer_latest_earlier_section(spark):
    rows = [("1", "a.md", ["T"], 0), ("2", "a.md", ["T", "X"], 10), ("3", "a.md", ["T", "X", "Y"], 20), ("4", "a.md", ["T", "X"], 30),
            ("5", "a.md", ["T", "X", "Y"], 40), ("6", "a.md", ["Q", "R"], 50)]
    frame = spark.createDataFrame(rows, "doc_id string, path string, heading_path array<string>, start_byte int")
    got = {r["doc_id"]: r["parent_id"] for r in indexing.link_doc_parents(frame).collect()}
    assert got == {"1": None, "2": "1", "3": "2", "4": "1", "5": "4", "6": None}


def test_lookup_stages(spark):
    rows = [("1", "p://x.py::C#foo@L1", "C.foo", "foo", "x.py", 0, "method"), ("2", "p://x.py::C#foobar@L2", "C.foobar", "foobar", "x.py", 9, "method"),
            ("3", "p://y.py#bar@L1", None, "bar", "y.py", 0, "function")]
    frame = spark.createDataFrame(rows, "sym_id string, symbol_key string, qualified_name string, name string, path string, start_byte int, kind string")

    def find(q, **k):
        return sorted(r["sym_id"] for r in lookup.lookup_symbols(frame, q, **k).collect())
    assert find("p://x.py::C#foo@L1") == ["1"]          # the raw key wins over its own prefix match
    assert find("p://x.py::C#foo") == ["1", "2"]
    assert find("C.foo(int)") == ["1"]
    assert find("bar") == ["3"]
    assert find("z.bar") == ["3"]
    assert find("nope") == []
    assert find("p://x.py", owner="foobar") == ["2"] and find("p://x.py", owner="absent") == ["1", "2"]


def test_min_match_and_fallback(spark):
    rows = [("doc", str(i), t, f"d{i}.md", b) for i, (t, b) in enumerate([("Alpha beta", "gamma"), ("Alpha", "x"), ("delta", "alpha beta")])]
    frame = spark.createDataFrame(rows, "entity_type string, entity_id string, title string, path string, body string")
    assert {r["entity_id"] for r in search.search_text(frame, "alpha beta gamma", limit=5).collect()} == {"0", "2"}
    assert [r["entity_id"] for r in search.search_text(frame, "---").collect()] == []
    assert usages.split_owner("a.b.c") == ("a.b", "c") and usages.split_owner("c", "K") == ("K", "c")


def test_noise_before_the_first_real_usage_hides_nothing_else(spark):
    from codeloom.operators import usages
    rows = [(f"tests/a{i:03d}.py", i, "f", None, "call", None, None, i, 0.95, "exact") for i in range(300)] + [("z/real.py", 1, "f", None, "call", None, None, 1, 0.5, "probable")]
    matches = spark.createDataFrame(rows, "path string, start_byte int, spelling string, receiver string, role string, enclosing_id string, target_id string, start_line int, confidence double, resolution_kind string")
    assert [r.path for r in usages.rank_usages(matches, 5).collect()] == ["z/real.py"]
    assert dict(usages.count_by_status(matches).collect()) == {"noise": 300, "shown": 1}
    assert dict(usages.count_by_status(matches, include_probable=False).collect()) == {"noise": 300, "confidence": 1}


def test_a_low_ranked_document_with_enough_words_is_found(spark):
    from codeloom.operators import search
    short = [("doc", str(i), "alpha", f"p{i:04d}", "alpha alpha") for i in range(400)]
    rows = [*short, ("doc", "long", "x", "q", "alpha beta gamma " + "other " * 3000)]
    documents = spark.createDataFrame(rows, "entity_type string, entity_id string, title string, path string, body string")
    found = search.search_text(search.index_words(documents), "alpha beta gamma", limit=5).collect()
    assert [r.entity_id for r in found] == ["long"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from codeloom.operators.lineage import ensure_checkpoint_dir
    for master, fails in (("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("yarn", True), ("local[4]", False), ("local", False)):
        made = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append, getConf=lambda: SimpleNamespace(get=lambda key: None))
        session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
        if fails:
            with pytest.raises(ValueError):
                ensure_checkpoint_dir(session)
        else:
            ensure_checkpoint_dir(session)
        assert bool(made) != fails


def test_subtypes_of_cycles_of_several_lengths(spark):
    edges, first = [], 1
    for length in (3, 4, 5):
        ring = list(range(first, first + length))
        edges += [(0, ring[0])] + list(zip(ring, ring[1:] + ring[:1]))
        first += length
    edges += [(0, 100), (100, 101), (0, 101), (5, 200)]   # a diamond apart from the cycles, and a node below one
    rows = [(f"n{b}", f"n{a}", "extends") for a, b in edges]
    walk = graph.subtypes(spark.createDataFrame(rows, "source_id string, target_id string, kind string"), spark.createDataFrame([("n0",)], "id string"))
    want = {("n100", 1), ("n101", 1), ("n101", 2), ("n200", 3)}
    want |= {(f"n{base + i}", i + 1) for base, length in ((1, 3), (4, 4), (8, 5)) for i in range(length)}
    assert sorted(map(tuple, walk.collect())) == sorted(want)
