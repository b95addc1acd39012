"""Headline queries, timed warm: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
The index over the tables is built once and reported as ``index_build``; queries run against it.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["resolve_occurrences", "resolution_edges", "symbol_lookup_cascade", "bm25_search", "rrf_hybrid", "proximity_rerank",
            "upstream_callers_d4", "downstream_callees_d2", "graph_proximity_d3", "implementations_transitive", "impact_summary",
            "affected_tests", "usages_by_file", "usages_count_warning", "file_dependents", "content_hash_drift", "linked_docs_topk",
            "session_dedup_window", "line_numbering", "markdown_sections", "java_symbols", "python_symbols"]
TREE_FILES = 300


def of_a_tree(spark, index, timed):
    """A tree of files made from the tables, indexed; then one file changes and one skeleton is asked for, both warm."""
    import tempfile
    from pathlib import Path

    from codeloom.engine import CodeIndex
    from codeloom.plans import generated
    root = Path(tempfile.mkdtemp(prefix="bench-tree-"))
    for row in generated.java(index).select("path", "content").limit(TREE_FILES).toLocalIterator():
        target = root / row["path"]
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(row["content"])
    tree = CodeIndex(spark, root)
    out = {"tree_index": timed(tree.index)}
    path = sorted(p.relative_to(root).as_posix() for p in root.rglob("*.java"))[0]
    for _ in range(2):
        (root / path).write_text((root / path).read_text() + "\n// changed\n")
        out["file_update"] = timed(lambda: tree.sync_path(path))
        out["skeleton"] = timed(lambda: tree.get_skeleton(path))
    return out


def main():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from codeloom.plans.carrier import index_of
    from codeloom.plans.catalog import QUERIES

    def timed(run):
        start = time.perf_counter()
        run()
        return round(time.perf_counter() - start, 3)

    def drain(name):
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    index = index_of(spark, SF_DIR)
    times = {"index_build": timed(lambda: (index.symbols, index.occurrences, index.resolved, index.search_index))}
    for name in HEADLINE:
        drain(name)   # all are timed warm
        times[name] = timed(lambda: drain(name))
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    tree = of_a_tree(spark, index, timed)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "tree": tree,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
