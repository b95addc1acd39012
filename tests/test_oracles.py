"""A cross-section of the catalog beside DuckDB; ``python -m checks.compare`` runs all of it."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["ident_tokens", "symbol_query_parts", "path_predicates", "ignore_filter", "content_hash_drift", "symbol_lookup_cascade",
         "file_dependents", "affected_tests", "resolve_occurrences", "usages_by_file", "upstream_callers_d4", "implementations_transitive",
         "graph_proximity_d3", "impact_summary", "bm25_min_match", "rrf_hybrid", "rrf_kinds_filter", "rrf_kinds_deep", "incremental_resolution", "incremental_edges", "proximity_rerank", "session_dedup_window",
         "markdown_sections", "python_references", "kotlin_symbols", "session_dedup_stream"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    result = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result[0] == "ok", result


def test_every_query_of_the_catalog_has_an_oracle():
    from codeloom.plans.catalog import QUERIES
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
