"""Index tables on shared storage, replaced atomically by groups of paths.

Rows live in ``<table>/version=<n>/bucket=<b>``, the bucket a hash of the path and the version a number of its own for each commit. A commit writes the touched buckets of each
table under a new number and then one manifest that names the live number of every table's buckets. Manifests are numbered, and the next number can be taken once only: of two writers that
started from the same manifest the later one finds its number taken, reads the buckets again and retries. Readers follow the newest manifest, so they see all tables of a commit or none.
A commit reads and writes touched buckets only.
"""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, functions as F

from codeloom import schemas
from codeloom.errors import CommitConflict
from codeloom.functions.paths import any_of

SCHEMAS = {"files": schemas.FILES, "symbols": schemas.SYMBOLS, "occurrences": schemas.OCCURRENCES, "docs": schemas.DOCS, "resolved": schemas.RESOLVED}
OF_FILES = ("files", "symbols", "occurrences", "docs")   # tables that a touched path's rows are replaced in
ATTEMPTS = 5


class IndexStore:
    def __init__(self, spark, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, str(root).rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _folder(self, name: str):
        """(file context, path) of a folder of the store."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf), path

    def _newest(self) -> int:
        """The number of the newest manifest, from their names; 0 without any."""
        context, folder = self._folder("manifest")
        if not context.util().exists(folder):
            return 0
        found = context.util().listStatus(folder)
        names = [found[i].getPath().getName() for i in range(len(found))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, number: int | None = None) -> dict[str, dict[int, int]]:
        """Live version of each written bucket by table; at most ``buckets`` entries a table."""
        number = self._newest() if number is None else number
        if not number:
            return {}
        text = self.spark.read.text(f"{self.root}/manifest/{number}.json", wholetext=True).first()[0]
        return {table: {int(b): v for b, v in live.items()} for table, live in json.loads(text).items()}

    def version(self) -> int:
        return self._newest()

    def _publish(self, number: int, live: dict) -> None:
        """Write a manifest under its number; a conflict if the number is taken."""
        context, folder = self._folder("manifest")
        jvm = self.spark._jvm
        staged = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
        system = staged.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = system.create(staged, False)
        out.write(bytearray(json.dumps(live, sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, jvm.org.apache.hadoop.fs.Path(folder, f"{number}.json"), options)
        except Py4JJavaError as error:
            system.delete(staged, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise CommitConflict(f"version {number} was committed by another writer") from None
            raise

    def exists(self) -> bool:
        return self._newest() > 0

    def read(self, table: str, only=None, live: dict[int, int] | None = None) -> DataFrame:
        """Live rows of a table, of the given buckets if any; the filter prunes partitions."""
        live = self.manifest().get(table, {}) if live is None else live
        live = {b: v for b, v in live.items() if only is None or b in only}
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        if not live:
            return self.spark.createDataFrame([], SCHEMAS[table])
        by_version = {}
        for bucket, version in live.items():
            by_version.setdefault(version, []).append(bucket)
        wanted = any_of((F.col("version") == v) & F.col("bucket").isin(b) for v, b in by_version.items())
        return (self.spark.read.schema(SCHEMAS[table] + ", version long, bucket int").parquet(f"{self.root}/{table}")
                .where(wanted).select(*columns))

    def _write(self, table: str, rows: DataFrame | None, touched: DataFrame, live: dict[int, int]) -> dict[int, int]:
        """Rows of the touched paths replaced; the live versions of the table after that."""
        hit = {r[0] for r in touched.select(self._bucket()).distinct().collect()}   # at most ``buckets`` values
        if not hit:
            return live
        version = uuid.uuid4().int >> 66   # 62 bits: a folder of its own for each attempt
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        kept = self.read(table, only=hit, live=live).join(touched, "path", "left_anti").select(*columns)
        rows = kept if rows is None else kept.unionByName(rows.select(*columns))
        (rows.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.hash("path"), F.lit(16)))
         .write.partitionBy("bucket").parquet(f"{self.root}/{table}/version={version}"))
        return live | {bucket: version for bucket in hit}

    def commit(self, incoming: dict[str, DataFrame], touched: DataFrame, others: dict[str, tuple[DataFrame, DataFrame]] | None = None,
               base: int | None = None) -> int:
        """Replace the rows of the touched paths in every table of files; returns the new version. ``others`` are further tables, each with
        its rows and the paths that these replace. With ``base``, the commit stands only on that version: a later one is a conflict; without, it is made anew on what others committed."""
        touched = touched.select("path").distinct()
        if touched.isEmpty() and not others:
            return self.version()
        changes = {table: (incoming.get(table), touched) for table in OF_FILES} | (others or {})
        for attempt in range(ATTEMPTS):
            number = self.version() if base is None else base
            live = self.manifest(number)
            made = {table: self._write(table, rows, paths.select("path").distinct(), live.get(table, {})) for table, (rows, paths) in changes.items()}
            try:
                self._publish(number + 1, live | made)
                return number + 1
            except CommitConflict:
                if base is not None or attempt + 1 == ATTEMPTS:
                    raise
        return self.version()
