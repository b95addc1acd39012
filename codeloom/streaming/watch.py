"""Keeping a stored index in step with a changing tree."""

from pyspark.sql import DataFrame, functions as F

from codeloom import schemas
from codeloom.errors import CommitConflict
from codeloom.functions import paths
from codeloom.operators import build, indexing, maintain
from codeloom.operators.lineage import materialize
from codeloom.operators.skew import FEW
from codeloom.sources import repo_files


ATTEMPTS = 3   # of a change that other writers overtake


def sync_batch(store, changed: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
    """Index changed files and drop removed paths; files with a known hash are skipped. The stored resolution is kept in step: only occurrences that the change
    can reach are resolved. A change that another writer overtakes is made anew."""
    for attempt in range(ATTEMPTS):
        try:
            return _sync(store, changed, removed)
        except CommitConflict:
            if attempt + 1 == ATTEMPTS:
                raise


def _sync(store, changed: DataFrame, removed: DataFrame | None) -> dict[str, int]:
    base = store.version()
    hashed = build.with_hash(changed).withColumn("language", paths.language_of("path"))
    known = store.read("files").select("path", "content_hash")
    if known.limit(FEW + 1).count() <= FEW:
        known = F.broadcast(known)   # then no content moves
    fresh = hashed.join(known, ["path", "content_hash"], "left_anti").persist()
    try:
        touched = fresh.select("path")
        if removed is not None:
            touched = touched.unionByName(removed.select("path"))
        touched = materialize(touched.distinct())
        total, indexed = changed.count(), fresh.count()
        if touched.isEmpty():
            return {"total_files": total, "indexed_files": 0, "skipped_files": total}
        tables = build.build_index(fresh)
        # files and sections are read once, by the commit
        tables |= build.written({name: tables[name] for name in ("symbols", "occurrences")})
        before = {name: store.read(name) for name in ("symbols", "occurrences", "resolved")}
        after = {name: indexing.upsert(before[name], tables[name], touched) for name in ("symbols", "occurrences")}
        change = maintain.maintain(before["resolved"], after["occurrences"], after["symbols"], touched, before["symbols"])
        moved = touched.unionByName(change.stale.select("path")).unionByName(change.fresh.select("path")).distinct()
        moved = materialize(moved)
        rows = maintain.applied(before["resolved"].join(moved, "path", "left_semi"), change, touched)
        store.commit(tables, touched, {"resolved": (rows, moved)}, base)
        return {"total_files": total, "indexed_files": indexed, "skipped_files": total - indexed}
    finally:
        fresh.unpersist()


def index_tree(spark, store, root, config, gitignore=()) -> dict[str, int]:
    """Full or incremental scan: the tree is listed once, files whose size or time differ from the index are read and those whose hash differs are parsed, vanished
    ones dropped. A file that is moved in with an old time is new all the same. Files that are too large are counted."""
    listed = materialize(repo_files.listing(spark, root, config, gitignore))
    found = listed.where(F.col("skipped_reason").isNull())
    known = store.read("files")
    gone = known.select("path").join(found.select("path"), "path", "left_anti")
    changed = repo_files.contents(found.join(known.select("path", "size_bytes", "mtime_ns"), ["path", "size_bytes", "mtime_ns"], "left_anti"), root)
    counts = sync_batch(store, changed, gone)
    tally = listed.agg(F.count_if(F.col("skipped_reason").isNull()).alias("files"), F.count("skipped_reason").alias("large")).first()
    return counts | {"total_files": tally["files"], "skipped_files": tally["files"] - counts["indexed_files"], "too_large_files": tally["large"]}


def sync_path(spark, store, root, config, path: str) -> bool:
    """Re-index or drop one path."""
    from codeloom.sources import guard
    target = guard.resolve(root, path)
    one = spark.createDataFrame([(path,)], "path string")
    if not target.exists():
        sync_batch(store, spark.createDataFrame([], schemas.SOURCES), one)
        return True
    if one.where(paths.language_of("path").isNotNull()).isEmpty():
        return False
    stat = target.stat()
    row = [(path, bytearray(target.read_bytes()), stat.st_size, stat.st_mtime_ns)]
    sync_batch(store, spark.createDataFrame(row, "path string, content binary, size_bytes long, mtime_ns long"))
    return True


def watch_tree(spark, store, root, config, gitignore, checkpoint: str, trigger: dict):
    """A streaming query that keeps the index in step; ``trigger`` as in ``writeStream.trigger``. Each trigger compares a listing of the tree with the index, so a change counts whatever
    the times of its files."""
    changes = repo_files.reader(spark.readStream, spark, root, config, gitignore, content=False)

    def apply(batch, _):
        index_tree(spark, store, root, config, gitignore)
    return (changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start())
