"""Index tables from source files: parse, key, link and resolve."""

import os

from pyspark.sql import DataFrame, functions as F

from codeloom.operators import indexing, pysyntax, sections, syntax
from codeloom.operators.lineage import materialize


def _id(*columns):
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))


PARSED_SYMBOLS = ("path string, language string, name string, qualified_name string, kind string, signature string, docstring string, "
                  "parent_key string, symbol_key string, start_byte int, end_byte int, start_line int, end_line int, "
                  "body_start_byte int, body_end_byte int")
PARSED_REFERENCES = ("path string, language string, spelling string, role string, start_byte int, end_byte int, start_line int, "
                     "end_line int, receiver string, enclosing_key string")


def parse_sources(files: DataFrame):
    """(symbols, references, sections, errors) of files with path, language and content.

    Only parsers of languages that occur are planned; their number is fixed.
    """
    empty = files.sparkSession.createDataFrame
    symbols, references = empty([], PARSED_SYMBOLS), empty([], PARSED_REFERENCES)
    errors = empty([], "path string, parse_error_count int")
    present = {r[0] for r in files.select("language").distinct().collect()}
    if present & set(syntax.LANGUAGES):
        found, refs, bad = syntax.parse(files, os.environ.get("CODELOOM_PARSER_BACKEND", "nested"))
        symbols, errors = symbols.unionByName(found), errors.unionByName(bad)
        references = references.unionByName(syntax.enclose_references(refs, found))
    if "python" in present:
        found, refs, bad = pysyntax.parse(files)
        symbols, errors = symbols.unionByName(found), errors.unionByName(bad)
        references = references.unionByName(refs)
    return symbols.dropDuplicates(["path", "symbol_key"]), references, sections.parse(files), errors


def build_index(files: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, occurrences (unresolved) and docs of the given source files.

    ``files`` holds path, language, content, content_hash, size_bytes, mtime_ns.
    """
    symbols, references, docs, errors = parse_sources(files)
    symbols = symbols.withColumn("sym_id", _id("symbol_key"))
    symbols = indexing.link_parents(symbols).withColumn("visibility", F.lit("public")).select(
        "sym_id", "path", "parent_id", "symbol_key", "qualified_name", "name", "kind", "visibility", "signature", "docstring",
        "start_byte", "end_byte", "start_line", "end_line", F.col("start_byte").alias("signature_start_byte"),
        F.coalesce("body_start_byte", "end_byte").alias("signature_end_byte"), "body_start_byte", "body_end_byte")
    occurrences = references.select(
        _id("path", "start_byte", "end_byte", "role", "spelling").alias("occ_id"), "path",
        F.when(F.col("enclosing_key").isNotNull(), F.md5("enclosing_key")).alias("enclosing_id"),
        "spelling", "role", "start_byte", "end_byte", "start_line", "end_line", "receiver")
    docs = docs.withColumn("doc_id", _id("path", "start_byte", "start_line"))
    docs = indexing.link_doc_parents(docs).select(
        "doc_id", "path", "parent_id", "heading_level", "heading", "heading_path", "content",
        "start_byte", "end_byte", "start_line", "end_line")
    listing = files.join(errors, "path", "left").select(
        "path", "language", "content_hash", "mtime_ns", "size_bytes",
        (F.unix_micros(F.current_timestamp()) * 1000).alias("indexed_at_ns"),
        F.coalesce("parse_error_count", F.lit(0)).alias("parse_error_count"))
    return {"files": listing, "symbols": symbols, "occurrences": occurrences, "docs": docs}


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def written(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables written once, for an index that lives only in this session."""
    return {name: materialize(df) for name, df in tables.items()}
