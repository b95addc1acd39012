"""A code index derived row by row from the benchmark tables.

Parts are methods of their brand; regions, nations, suppliers and customers form a type
hierarchy; line items are calls between parts; events are calls nobody resolves; documents
are sections of markdown files. No step groups rows, so a hot key stays spread out.
"""

import functools
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.functions import identifiers as ident
from codeloom.functions import text
from codeloom.operators import postings, resolve, search
from codeloom.operators.lineage import materialize


def _lit(value, kind="string") -> Column:
    return F.lit(value).cast(kind)


class Carrier:
    """Index tables over one folder of benchmark parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def part_symbols(self) -> DataFrame:
        owner, size = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size").cast("string")
        path = (F.when(F.col("p_type") == "PROMO", F.concat(F.lit("tests/"), owner, F.lit("/promo_"), size, F.lit(".py")))
                .when(F.col("p_type") == "SMALL", F.concat(F.lit("src/"), owner, F.lit("/sample/small_"), size, F.lit(".py")))
                .otherwise(F.concat(F.lit("src/"), owner, F.lit("/"), F.lower("p_type"), F.lit("_"), size, F.lit(".py"))))
        rows = self.table("part").select(
            F.col("p_partkey").alias("sym_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
            owner.alias("owner"), F.lower("p_type").alias("part_type"), path.alias("path"), "p_size",
            F.concat("p_type", F.lit(" part of "), "p_brand").alias("docstring"))
        line = (F.col("sym_id") + 1).cast("int")
        return rows.select(
            "sym_id", "path", ident.symbol_key(F.lit("python"), "path", "owner", "name", line=line).alias("symbol_key"),
            F.concat("owner", F.lit("."), "name").alias("qualified_name"), "name", F.lit("method").alias("kind"),
            F.concat(F.lit("def "), "name", F.lit("(self, size: int)")).alias("signature"), "docstring",
            line.alias("start_line"), (line + F.col("p_size")).alias("end_line"),
            (F.col("sym_id") * 100).alias("start_byte"), "owner", "part_type")

    def _types(self, table, key, name, offset, path, kind, language="java", docstring=None, qualify=True) -> DataFrame:
        k = F.col(key).cast("long")
        rows = self.table(table).select(
            (-(k * 5 + offset)).alias("sym_id"), name.alias("name"), path.alias("path"), k.alias("_k"),
            _lit(kind).alias("kind"), (docstring if docstring is not None else _lit(None)).alias("docstring"))
        line = (F.col("_k") + 1).cast("int")
        word = "def " if language == "python" else "class "
        tail = "()" if language == "python" else ""
        return rows.where(F.col("name") != "").select(
            "sym_id", "path", ident.symbol_key(F.lit(language), "path", None, "name", line=line).alias("symbol_key"),
            (F.concat(F.lit("types."), "name") if qualify else F.col("name")).alias("qualified_name"), "name", "kind",
            F.concat(F.lit(word), "name", F.lit(tail)).alias("signature"), "docstring",
            line.alias("start_line"), (line + 1).alias("end_line"), (F.col("_k") * 64).alias("start_byte"))

    @cached_property
    def type_symbols(self) -> DataFrame:
        def keyed(prefix, column):
            return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(".java"))
        plain = lambda c: F.replace(c, F.lit("#"), F.lit("_"))
        first_word = F.regexp_extract("text", r"(?U)\b([A-Z][a-zA-Z0-9_]+)\b", 1)
        bench = F.concat(F.lit("bench/item_"), F.col("item_id").cast("string"), F.lit(".py"))
        parts = [
            self._types("region", "r_regionkey", F.col("r_name"), 1, _lit("types/Region.java"), "interface"),
            self._types("nation", "n_nationkey", F.col("n_name"), 2, _lit("types/Nation.java"), "class"),
            self._types("supplier", "s_suppkey", plain("s_name"), 3, keyed("types/supplier/S", "s_nationkey"), "class"),
            self._types("customer", "c_custkey", plain("c_name"), 4, keyed("types/customer/C", "c_nationkey"), "class",
                        docstring=F.col("c_mktsegment")),
            self._types("benchmark", "item_id", first_word, 5, bench, "function", "python", F.col("text"), False),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def symbols(self) -> DataFrame:
        return materialize(self.part_symbols.drop("owner", "part_type").unionByName(self.type_symbols))

    @cached_property
    def occurrences(self) -> DataFrame:
        caller = self.part_symbols.select(F.col("sym_id").alias("l_partkey"), F.col("path").alias("c_path"))
        callee = self.part_symbols.select(F.col("sym_id").alias("_callee"), F.col("path").alias("t_path"),
                                          "name", "owner", "part_type")
        calls = (self.table("lineitem")
                 .withColumn("_callee", F.col("l_suppkey") * 16 + F.col("l_linenumber"))
                 .join(caller, "l_partkey").join(callee, "_callee"))
        top_level = F.col("l_linestatus") == "F"
        line = (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).cast("int")
        calls = calls.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("occ_id"),
            F.when(top_level, F.col("t_path")).otherwise(F.col("c_path")).alias("path"),
            F.when(~top_level, F.col("l_partkey")).alias("enclosing_id"), F.col("name").alias("spelling"),
            F.when(F.col("l_linenumber") == 7, "instantiation").otherwise("call").alias("role"),
            F.when(F.col("l_returnflag") == "N", F.col("owner")).when(F.col("l_returnflag") == "R", F.col("part_type")).alias("receiver"),
            line.alias("start_line"), line.alias("end_line"),
            (F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("start_byte"))

        def supertypes(table, key, offset, nation_key, parent, parent_key, parent_name, role, path):
            k = F.col(key).cast("long")
            line = (k + 1).cast("int")
            names = self.table(parent).select(F.col(parent_key).alias(nation_key), F.col(parent_name).alias("spelling"))
            return self.table(table).join(names, nation_key).select(
                (-(k * 5 + offset)).alias("occ_id"), path.alias("path"), (-(k * 5 + offset)).alias("enclosing_id"),
                "spelling", _lit(role).alias("role"), _lit(None).alias("receiver"),
                line.alias("start_line"), line.alias("end_line"), (k * 64).alias("start_byte"))

        def keyed(prefix, column):
            return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(".java"))
        events = self.table("events").select(
            (-(F.col("event_id") * 5 + 5)).alias("occ_id"),
            F.concat(F.lit("tests/events/user_"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
            _lit(None, "long").alias("enclosing_id"), F.col("event_type").alias("spelling"), _lit("call").alias("role"),
            _lit("props").alias("receiver"), _lit(1, "int").alias("start_line"), _lit(1, "int").alias("end_line"),
            (F.col("event_id") * 64).alias("start_byte"))
        # written once: resolution reads this table several times
        return materialize(calls
                .unionByName(supertypes("nation", "n_nationkey", 2, "n_regionkey", "region", "r_regionkey", "r_name",
                                        "implements", _lit("types/Nation.java")))
                .unionByName(supertypes("supplier", "s_suppkey", 3, "s_nationkey", "nation", "n_nationkey", "n_name",
                                        "extends", keyed("types/supplier/S", "s_nationkey")))
                .unionByName(supertypes("customer", "c_custkey", 4, "c_nationkey", "nation", "n_nationkey", "n_name",
                                        "extends", keyed("types/customer/C", "c_nationkey")))
                .unionByName(events))

    @cached_property
    def resolved(self) -> DataFrame:
        """Occurrences with their targets, written once, as an index holds them."""
        return materialize(resolve.resolve_occurrences(self.occurrences, self.symbols))

    @cached_property
    def edges(self) -> DataFrame:
        return resolve.derive_edges(self.resolved)

    @cached_property
    def docs(self) -> DataFrame:
        level = (F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2)
                 .when(F.col("lang") == "de", 3).otherwise(4))
        return self.table("documents").select(
            "doc_id", doc_path().alias("path"), level.alias("heading_level"), F.col("source").alias("heading"),
            F.array("lang", "source").alias("heading_path"), F.col("text").alias("content"),
            F.lit(1).alias("start_line"), F.size(text.split_lines("text")).alias("end_line"))

    @cached_property
    def files(self) -> DataFrame:
        prose = self.table("documents").select(
            doc_path().alias("path"), _lit("markdown").alias("language"), F.sha2("text", 256).alias("content_hash"),
            F.octet_length("text").cast("long").alias("size_bytes"))
        code = self.symbols.select("path").distinct().select(
            "path", F.when(F.endswith("path", F.lit(".py")), "python").otherwise("java").alias("language"),
            F.sha2("path", 256).alias("content_hash"), F.octet_length("path").cast("long").alias("size_bytes"))
        return prose.unionByName(code)

    @cached_property
    def search_documents(self) -> DataFrame:
        return search.search_documents(self.symbols, self.occurrences, self.docs)

    @cached_property
    def search_index(self) -> postings.TextIndex:
        """The inverted index of the search documents, written once."""
        return postings.build(self.search_documents)

    @cached_property
    def sources(self) -> DataFrame:
        return self.table("documents").select(doc_path().alias("path"), "text")


@functools.lru_cache(maxsize=8)
def _index(spark: SparkSession, application: str, sf_dir: str) -> Carrier:
    return Carrier(spark, sf_dir)


def index_of(spark: SparkSession, sf_dir: str) -> Carrier:
    """The index over a folder, shared by all queries of one application."""
    return _index(spark, spark.sparkContext.applicationId, sf_dir)


def doc_path() -> Column:
    return F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"),
                    F.col("doc_id").cast("string"), F.lit(".md"))
