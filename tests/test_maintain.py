"""Maintenance of a stored resolution, and commits of several writers."""

import random

import pytest

from codeloom.errors import CommitConflict
from codeloom.operators import maintain, resolve
from codeloom.sources.store import SCHEMAS, IndexStore

SYMBOLS = "sym_id string, path string, symbol_key string, qualified_name string, name string, start_byte int"
OCCURRENCES = "occ_id string, path string, enclosing_id string, spelling string, role string, receiver string"


def generation(rng, paths):
    symbols, occurrences = [], []
    for path in paths:
        for i in range(rng.randint(0, 4)):
            name = f"n{rng.randint(0, 12)}"
            symbols.append((f"{path}#{i}", path, f"{path}::{name}@{i}", f"{rng.choice('ABC')}.{name}", name, i * 10))
        for i in range(rng.randint(0, 6)):
            occurrences.append((f"{path}!{i}", path, rng.choice([None, f"{path}#0"]), f"n{rng.randint(0, 12)}", rng.choice(["call", "extends"]), rng.choice([None, "A", "B", ""])))
    return symbols, occurrences


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maintained_rows_and_edges_equal_a_full_resolution(spark, seed):
    """Files are added, changed and deleted at once."""
    rng = random.Random(seed)
    paths = [f"f{i}" for i in range(14)]
    symbols, occurrences = generation(rng, paths[:11])
    touched = [*rng.sample(paths[:11], 4), *paths[11:]]
    new_symbols, new_occurrences = generation(rng, [p for p in touched if p not in touched[:2]])   # the first two are deleted
    after_symbols = [s for s in symbols if s[1] not in touched] + new_symbols
    after_occurrences = [o for o in occurrences if o[1] not in touched] + new_occurrences
    before, after = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(after_symbols, SYMBOLS)
    old = resolve.resolve_occurrences(spark.createDataFrame(occurrences, OCCURRENCES), before)
    marked = spark.createDataFrame([(p,) for p in touched], "path string")
    change = maintain.maintain(old, spark.createDataFrame(after_occurrences, OCCURRENCES), after, marked, before)
    full = resolve.resolve_occurrences(spark.createDataFrame(after_occurrences, OCCURRENCES), after)

    def listed(rows):
        return sorted(map(repr, rows.collect()))
    assert listed(maintain.applied(old, change, marked).select(*full.columns)) == listed(full)
    edges = maintain.with_edges(resolve.derive_edges(old), maintain.edge_changes(change))
    assert listed(edges) == listed(resolve.derive_edges(full).select(*edges.columns))


def test_only_reached_occurrences_are_resolved(spark):
    symbols = [("s1", "a", "a::x", "A.x", "x", 0), ("s2", "b", "b::y", "B.y", "y", 0)]
    occurrences = [("o1", "c", None, "x", "call", None), ("o2", "c", None, "y", "call", None), ("o3", "b", None, "x", "call", None)]
    before = spark.createDataFrame(symbols, SYMBOLS)
    after = spark.createDataFrame([symbols[0], ("s3", "b", "b::z", "B.z", "z", 0)], SYMBOLS)
    found = spark.createDataFrame(occurrences, OCCURRENCES)
    change = maintain.maintain(resolve.resolve_occurrences(found, before), found, after, spark.createDataFrame([("b",)], "path string"), before)
    assert {r.name for r in change.names.collect()} == {"y", "z"}
    assert {r.occ_id: r.target_id for r in change.fresh.collect()} == {"o2": None, "o3": "s1"}


def file_rows(spark, paths, tag):
    return spark.createDataFrame([(p, "python", tag, 0, 1, 0, 0) for p in paths], SCHEMAS["files"])


def test_two_writers_on_one_version_conflict_and_one_retries(spark, tmp_path):
    one, two = (IndexStore(spark, str(tmp_path), buckets=4) for _ in range(2))
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert not one.exists() and one.version() == 0
    base = one.commit({"files": file_rows(spark, ["a", "b"], "1")}, paths("a", "b"))
    assert one.commit({"files": file_rows(spark, ["a"], "2")}, paths("a"), base=base) == base + 1
    with pytest.raises(CommitConflict):   # decided on rows of the earlier version
        two.commit({"files": file_rows(spark, ["b"], "3")}, paths("b"), base=base)
    assert two.commit({"files": file_rows(spark, ["b"], "3")}, paths("b")) == base + 2
    assert {r.path: r.content_hash for r in one.read("files").collect()} == {"a": "2", "b": "3"}


def test_a_commit_that_is_overtaken_is_made_on_the_rows_of_the_other(spark, tmp_path, monkeypatch):
    store, other = IndexStore(spark, str(tmp_path), buckets=1), IndexStore(spark, str(tmp_path), buckets=1)
    one = lambda p: spark.createDataFrame([(p,)], "path string")
    write, calls = store._write, []

    def overtaken(table, rows, touched, live):
        if not calls:
            calls.append(other.commit({"files": file_rows(spark, ["x"], "other")}, one("x")))
        return write(table, rows, touched, live)
    monkeypatch.setattr(store, "_write", overtaken)
    assert store.commit({"files": file_rows(spark, ["y"], "mine")}, one("y")) == 2
    assert {r.path: r.content_hash for r in store.read("files").collect()} == {"x": "other", "y": "mine"}
