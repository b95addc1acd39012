"""File skeletons: function bodies cut out of the source, declarations and comments kept."""

from pyspark.sql import DataFrame, Window, functions as F

from codeloom import constants as C

FUNCTIONS = ("method", "function", "constructor")
BLOCK = "{\n        // " + C.OMITTED + "\n    }"
EXPRESSION = "= ..."


def redactions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Outermost function bodies with the text that replaces each."""
    bodies = symbols.where(F.col("kind").isin(*FUNCTIONS) & F.col("body_start_byte").isNotNull())
    # one that begins before another and ends after its start is around it
    earlier = Window.partitionBy("path").orderBy("start_byte").rangeBetween(Window.unboundedPreceding, -1)
    bodies = bodies.select("path", "language", "name", "docstring", "symbol_key", "start_byte", "end_byte", "body_start_byte", "body_end_byte")
    outer = bodies.withColumn("_reach", F.max("end_byte").over(earlier)).where("coalesce(_reach <= start_byte, true)")
    placed = outer.join(files.select("path", "content"), "path")
    head = F.substring("content", F.col("body_start_byte") + 1, 1).cast("string")
    # Python bodies go from the start of their first line to the end of the function
    # what stands before a body is looked at from the function's start on, not from the file's: the work follows the functions' own sizes
    before = F.substring("content", F.col("start_byte") + 1, F.col("body_start_byte") - F.col("start_byte")).cast("string")
    trimmed = F.rtrim(before, F.lit(" \t"))
    pad = F.octet_length(before) - F.octet_length(trimmed)
    own_line = trimmed.endswith("\n")
    indent = F.repeat(F.lit(" "), pad)
    only_doc = F.substring("content", F.col("body_start_byte") + 1, 3).cast("string").rlike("^[rRuU]?[\"']") & F.col("docstring").isNotNull()
    python = F.when(own_line, F.when(only_doc, F.concat(F.lit('"""'), "docstring", F.lit('"""\n'), indent)).otherwise(F.lit("")))
    marker = F.when(F.col("language") == "python", F.concat(python, F.lit("# " + C.OMITTED))).when(head == "{", BLOCK).otherwise(EXPRESSION)
    return placed.select("path", F.col("body_start_byte").alias("from_byte"), F.col("body_end_byte").alias("to_byte"),
                         marker.alias("marker"), "symbol_key", "name").where(F.col("marker").isNotNull())


def render(files: DataFrame, cuts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Skeleton text per file; ``cuts`` do not overlap."""
    listed = cuts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("from_byte", "to_byte", "marker"))).alias("_cuts"))
    rows = files.select("path", "content").join(listed, "path", "left")
    none = F.array().cast("array<struct<from_byte:int,to_byte:int,marker:string>>")
    rows = rows.withColumn("_cuts", F.coalesce("_cuts", none))
    n = F.size("_cuts")

    def piece(cut, i):
        begin = F.when(i == 0, 0).otherwise(F.try_element_at("_cuts", i)["to_byte"])
        return F.concat(F.substring("content", begin + 1, cut["from_byte"] - begin).cast("string"), cut["marker"])
    tail = F.when(n == 0, F.col("content").cast("string")).otherwise(
        F.substring(F.col("content"), F.try_element_at("_cuts", n)["to_byte"] + 1, F.octet_length("content")).cast("string"))
    out = rows.select("path", F.concat(F.array_join(F.transform("_cuts", piece), ""), tail).alias("skeleton"))
    if max_chars is None:
        return out
    notice = F.lit(C.SKELETON_NOTICE % max_chars)
    return out.withColumn("skeleton", F.when(F.length("skeleton") > max_chars, F.concat(
        F.substring("skeleton", 1, max_chars), notice)).otherwise(F.col("skeleton")))
