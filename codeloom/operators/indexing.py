"""Discovery filters, drift detection and row-level upserts of the index tables."""

from pyspark.sql import DataFrame, Window, functions as F

from codeloom import constants as C
from codeloom.functions import paths


def visible(listing: DataFrame, excludes=C.DEFAULT_EXCLUDES, gitignore=()) -> DataFrame:
    """Supported, visible and not ignored files, with their language."""
    return (listing.where(~paths.is_hidden("path"))
            .where(~paths.is_ignored("path", excludes, gitignore))
            .withColumn("language", paths.language_of("path"))
            .where(F.col("language").isNotNull()))


def too_large(files: DataFrame, max_file_bytes: int = C.MAX_FILE_BYTES) -> DataFrame:
    """``skipped_reason`` of files that are too large to parse; null for all others."""
    return files.withColumn("skipped_reason", F.when(F.col("size_bytes") > max_file_bytes, "too_large"))


def discoverable(listing: DataFrame, excludes=C.DEFAULT_EXCLUDES, gitignore=(),
                 max_file_bytes: int = C.MAX_FILE_BYTES) -> DataFrame:
    """Supported, visible, not ignored and not oversized files, with their language."""
    return visible(listing, excludes, gitignore).where(F.col("size_bytes") <= max_file_bytes)


def drift(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status) of every path in a scan or an index, compared by content hash."""
    both = (scan.select("path", F.col("content_hash").alias("_new"))
            .join(indexed.select("path", F.col("content_hash").alias("_old")), "path", "full_outer"))
    return both.select("path", F.when(F.col("_old").isNull(), "added")
                       .when(F.col("_new").isNull(), "deleted")
                       .when(F.col("_new") == F.col("_old"), "unchanged")
                       .otherwise("changed").alias("status"))


def upsert(current: DataFrame, incoming: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of untouched paths with the new rows of touched ones; a deleted path has none."""
    kept = current.join(touched.select("path").distinct(), "path", "left_anti")
    return kept.select(*current.columns).unionByName(incoming.select(*current.columns))


def link_parents(symbols: DataFrame) -> DataFrame:
    """``parent_id`` from ``parent_key`` among the symbols of the same file."""
    parents = symbols.select("path", F.col("symbol_key").alias("parent_key"), F.col("sym_id").alias("parent_id"))
    return symbols.join(parents, ["path", "parent_key"], "left")


def link_doc_parents(docs: DataFrame) -> DataFrame:
    """Parent section of each section: the latest earlier one whose heading path is one shorter.

    Windows run inside one file, whose size discovery bounds.
    """
    depth = F.size("heading_path")
    own, above = F.col("heading_path"), F.slice("heading_path", F.lit(1), F.greatest(depth - 1, F.lit(1)))
    # each section is looked up under its parent path and offered under its own path; the offer carries no other column
    row = F.struct(*docs.columns)
    nothing = F.lit(None).cast(docs.select(row.alias("r")).schema["r"].dataType)
    unnamed = F.lit(None).cast(docs.schema["doc_id"].dataType)
    ask = F.struct(above.alias("_path"), unnamed.alias("_offer"), row.alias("_row"))
    offer = F.struct(own.alias("_path"), F.col("doc_id").alias("_offer"), nothing.alias("_row"))
    order = Window.partitionBy("path", "_path").orderBy("start_byte", F.col("_offer").isNotNull())
    found = F.last("_offer", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = docs.select("path", "start_byte", F.explode(F.array(ask, offer)).alias("_at")).select("path", "start_byte", "_at.*")
    rows = rows.withColumn("_found", found).where(F.col("_row").isNotNull()).select("_row.*", "_found")
    return rows.select(*docs.columns, F.when(depth > 1, F.col("_found")).alias("parent_id"))
