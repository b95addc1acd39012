"""Symbols and references of Python files."""

from pyspark.sql import DataFrame, functions as F

from codeloom.functions import identifiers as ident
from codeloom.operators.lineage import materialize
from codeloom.sources import python_nodes

def parse(files: DataFrame):
    """(symbols, references, errors) of the Python files among ``files``."""
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = files.where(F.col("language") == "python").select("path", "content").repartition(spread, "path")
    # written once: every table below reads the nodes
    nodes = materialize(sources.mapInPandas(python_nodes.read_nodes, python_nodes.SCHEMA))
    errors = nodes.groupBy("path").agg(F.max(F.coalesce("parse_error", F.lit(0))).alias("parse_error_count"))
    return _symbols(nodes), _references(nodes), errors


def _keyed(definitions: DataFrame) -> DataFrame:
    return definitions.withColumn("symbol_key", ident.symbol_key(F.lit("python"), "path", "scope", "name", line="start_line"))


def _around():
    """Key of the definition around a row."""
    name = F.substring_index("scope", ".", -1)
    owner = F.substring("scope", F.lit(1), F.length("scope") - F.length(name) - 1)
    return F.when(F.col("parent_line").isNotNull(), ident.symbol_key(F.lit("python"), "path", owner, name, line="parent_line"))


def _symbols(nodes: DataFrame) -> DataFrame:
    defs = _keyed(nodes.where(F.col("what").isin("class", "def")))
    signature = F.when(F.col("what") == "class", F.concat(
        F.lit("class "), "name", F.when(F.col("bases") != "", F.concat(
            F.lit("("), F.replace("bases", F.lit(","), F.lit(", ")), F.lit(")"))).otherwise(""))).otherwise(
        F.regexp_replace("head", r"\s*:\s*(?:#[^\n]*\s*)*\z", ""))
    return defs.select(
        "path", F.lit("python").alias("language"), "name",
        F.when(F.col("scope") != "", F.concat("scope", F.lit("."), "name")).otherwise(F.col("name")).alias("qualified_name"),
        F.when(F.col("what") == "class", "class").when(F.col("scope") != "", "method").otherwise("function").alias("kind"),
        signature.alias("signature"), "docstring", _around().alias("parent_key"), "symbol_key", "start_byte", "end_byte", "start_line", "end_line",
        "body_start_byte", F.col("end_byte").alias("body_end_byte"))


def _references(nodes: DataFrame) -> DataFrame:
    calls = nodes.where(F.col("what") == "call").select(
        "path", F.lit("python").alias("language"), F.col("name").alias("spelling"), F.lit("call").alias("role"),
        "start_byte", "end_byte", "start_line", "end_line", "receiver", _around().alias("enclosing_key"))
    bases = _keyed(nodes.where(F.col("what").isin("class", "def"))).where(F.col("bases") != "").select(
        "path", F.lit("python").alias("language"), F.explode(F.split("bases", ",")).alias("spelling"), F.lit("extends").alias("role"),
        "start_byte", "end_byte", "start_line", "end_line", F.lit(None).cast("string").alias("receiver"),
        F.col("symbol_key").alias("enclosing_key"))
    return calls.unionByName(bases)
