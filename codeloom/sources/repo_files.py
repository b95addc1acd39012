"""Spark data source over a source tree: ``spark.read.format("repo_files").load(root)``.

Spark's own file sources skip names that start with ``_`` or ``.`` and would lose
``__init__.py``. The driver lists directories only; tasks read the files of their directories.
As a stream it returns files whose modification time lies in the batch's interval.

Options: ``excludes`` and ``gitignore`` (newline-separated), ``maxFileBytes``, ``content``
(false for a listing without file content), ``dirsPerTask``.
"""

import os
import re
import time

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from codeloom import constants as C
from codeloom import schemas
from codeloom.functions.paths import glob_regex


BATCH_BYTES = 16 << 20
COLUMNS = tuple(field.split()[0] for field in schemas.SOURCES.split(", "))


class Directories(InputPartition):
    def __init__(self, dirs, after=None, upto=None):
        self.dirs, self.after, self.upto = dirs, after, upto


class _Tree:
    def __init__(self, options):
        self.root = options["path"]
        self.max_bytes = int(options.get("maxFileBytes", C.MAX_FILE_BYTES))
        self.with_content = options.get("content", "true").lower() == "true"
        self.per_task = int(options.get("dirsPerTask", "64"))
        excludes = options.get("excludes", "\n".join(C.DEFAULT_EXCLUDES)).split("\n")
        ignored = [p.rstrip("/") for p in options.get("gitignore", "").split("\n") if p]
        self.by_path = [re.compile(glob_regex(p.removesuffix("/**"))) for p in excludes] + [re.compile(glob_regex(p)) for p in ignored]
        self.by_name = [re.compile(glob_regex(p)) for p in ignored if "/" not in p]

    def _skip(self, rel, name):
        # whole directories only; Spark filters single files with the same rules afterwards
        return (name.startswith(".") or any(p.match(rel) for p in self.by_path)
                or any(p.match(name) for p in self.by_name))

    def directories(self):
        todo = [""]
        while todo:
            rel = todo.pop()
            yield rel
            try:
                children = [e.name for e in os.scandir(os.path.join(self.root, rel)) if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
            for name in children:
                below = f"{rel}/{name}" if rel else name
                if not self._skip(below, name):
                    todo.append(below)

    def partitions(self, after=None, upto=None):
        dirs = list(self.directories())
        return [Directories(dirs[i:i + self.per_task], after, upto) for i in range(0, len(dirs), self.per_task)]

    def rows(self, part):
        for rel in part.dirs:
            try:
                entries = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
            except OSError:
                continue
            for entry in entries:
                if entry.name.startswith(".") or not entry.name.endswith(tuple(C.LANGUAGE_EXTENSIONS)):
                    continue
                try:
                    if not entry.is_file():
                        continue
                    stat = entry.stat()
                    if part.upto is not None and not part.after < stat.st_mtime_ns <= part.upto:
                        continue
                    content = None
                    if self.with_content and stat.st_size <= self.max_bytes:   # a larger file is listed without content
                        with open(entry.path, "rb") as f:
                            content = f.read()
                except OSError:
                    continue   # a file that vanishes or cannot be read is left out
                yield (f"{rel}/{entry.name}" if rel else entry.name, content, stat.st_size, stat.st_mtime_ns)

    def batches(self, part):
        """Rows in Arrow batches of bounded bytes, whatever the file sizes."""
        rows, held = [], 0
        for row in self.rows(part):
            rows.append(row)
            held += len(row[1] or b"") + 256
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows):
    types = (pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(COLUMNS))


class RepoFilesReader(DataSourceReader):
    def __init__(self, options):
        self.tree = _Tree(options)

    def partitions(self):
        return self.tree.partitions()

    def read(self, partition):
        return self.tree.batches(partition)


class RepoFilesStream(DataSourceStreamReader):
    def __init__(self, options):
        self.tree = _Tree(options)

    def initialOffset(self):
        return {"mtime_ns": -1}

    def latestOffset(self):
        return {"mtime_ns": time.time_ns()}

    def partitions(self, start, end):
        return self.tree.partitions(start["mtime_ns"], end["mtime_ns"])

    def read(self, partition):
        return self.tree.batches(partition)

    def commit(self, end):
        pass


class RepoFiles(DataSource):
    @classmethod
    def name(cls):
        return "repo_files"

    def schema(self):
        return schemas.SOURCES

    def reader(self, schema):
        return RepoFilesReader(self.options)

    def streamReader(self, schema):
        return RepoFilesStream(self.options)


def listing(spark, root, config, gitignore=()):
    """Discovered files of a tree without their contents: path, size_bytes, mtime_ns, language, and ``skipped_reason`` for those that are too large to index."""
    from codeloom.operators.indexing import too_large, visible
    found = visible(reader(spark.read, spark, root, config, gitignore, content=False), config.repository.exclude, gitignore)
    return too_large(found.drop("content"), config.repository.max_file_bytes)


def contents(files, root):
    """Files (path, size_bytes, mtime_ns) with their ``content``, read by tasks in batches of bounded bytes; a file that vanished since is left out."""
    root = str(root)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for path, size, mtime in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                rows.append((path, content, size, mtime))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
    return files.select("path", "size_bytes", "mtime_ns").mapInArrow(run, schemas.SOURCES)


def scan(spark, root, config, gitignore=(), content=True):
    """Discovered files of a tree: path, content, size_bytes, mtime_ns, language."""
    from codeloom.operators.indexing import discoverable
    return discoverable(reader(spark.read, spark, root, config, gitignore, content), config.repository.exclude, gitignore,
                        config.repository.max_file_bytes)


def reader(source, spark, root, config, gitignore=(), content=True):
    """Rows of ``spark.read`` or ``spark.readStream`` over a tree."""
    spark.dataSource.register(RepoFiles)
    return (source.format("repo_files").option("excludes", "\n".join(config.repository.exclude))
            .option("gitignore", "\n".join(gitignore)).option("maxFileBytes", config.repository.max_file_bytes)
            .option("content", str(content).lower()).load(str(root)))
