"""Sections of Markdown files."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import paths, text
from codeloom.operators.syntax import source_text

HEADING = r"^(#{1,6})\s+(.+)$"
FENCE = r"^\s*```"


def _has_heading(lines) -> Column:
    """Whether a heading stands outside fenced blocks."""
    def step(state, line):
        fence = line.rlike(FENCE)
        fenced = state["fenced"] != fence
        return F.struct(fenced.alias("fenced"), (state["found"] | (~fence & ~fenced & line.rlike(HEADING))).alias("found"))
    return F.aggregate(lines, F.struct(F.lit(False).alias("fenced"), F.lit(False).alias("found")), step)["found"]


def parse(files: DataFrame) -> DataFrame:
    """One row per heading: level, heading path, own text up to the next heading, ranges.

    A file without headings is one section named after the file. Windows run inside one file,
    after the files were split by path once.
    """
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = files.where(F.col("language") == "markdown").select("path", source_text("content").alias("text"))
    headed = _has_heading(text.split_lines("text"))
    # each text moves once, in one of the two halves; both are split alike
    whole = files.where(~headed).repartition(spread, "path")
    files = files.where(headed).repartition(spread, "path").select("path", text.split_lines("text").alias("_lines"), F.octet_length("text").alias("_total"))
    lines = files.select("path", "_total", F.posexplode("_lines").alias("idx", "line"))
    order = Window.partitionBy("path").orderBy("idx")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(FENCE)
    fenced = F.sum(fence.cast("int")).over(upto) % 2 == 1
    heading = (~fence & ~fenced & F.col("line").rlike(HEADING)).cast("int")
    lines = (lines.withColumn("_end", F.sum(F.octet_length("line") + 1).over(upto).cast("int"))
             .withColumn("_is", heading).withColumn("_section", F.sum("_is").over(upto)))
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("_is") == 0, F.struct("idx", "line")))), lambda s: s["line"]), "\n")
    head = F.max(F.when(F.col("_is") == 1, F.col("line")))
    cut = lines.where(F.col("_section") > 0).groupBy("path", "_section").agg(
        head.alias("_head"), body.alias("content"), F.min("idx").alias("_first"), F.max("idx").alias("_last"),
        F.min(F.col("_end") - F.octet_length("line") - 1).alias("start_byte"),
        F.least(F.max("_end"), F.max("_total")).alias("end_byte"))
    cut = cut.select(
        "path", "_section", F.length(F.regexp_extract("_head", HEADING, 1)).alias("heading_level"),
        F.trim(F.regexp_extract("_head", HEADING, 2)).alias("heading"),
        F.regexp_replace("content", r"^\s+|\s+\z", "").alias("content"), "start_byte", "end_byte",
        (F.col("_first") + 1).alias("start_line"), (F.col("_last") + 1).alias("end_line"))
    # ancestors: per level the latest heading, if nothing shallower came after it
    above = Window.partitionBy("path").orderBy("_section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = {n: F.last(F.when(F.col("heading_level") == n, F.struct("_section", "heading")), ignorenulls=True).over(above)
              for n in range(1, 7)}
    for n, column in latest.items():
        cut = cut.withColumn(f"_h{n}", column)
    trail = []
    for n in range(1, 7):
        # the latest heading of level n counts when it lies above this one and no shallower one follows it
        shallower = F.greatest(F.lit(0), F.lit(0), *(F.coalesce(F.col(f"_h{m}._section"), F.lit(0)) for m in range(1, n)))
        trail.append(F.when((F.col("heading_level") >= n) & (F.col(f"_h{n}._section") > shallower), F.col(f"_h{n}.heading")))
    headed = cut.withColumn("heading_path", F.array_compact(F.array(*trail))).drop(*(f"_h{n}" for n in range(1, 7)), "_section")
    whole = whole.where(F.trim(F.regexp_replace("text", r"\s", "")) != "").select(
        "path", F.lit(1).alias("heading_level"), paths.file_name("path").alias("heading"),
        F.regexp_replace("text", r"^\s+|\s+\z", "").alias("content"), F.lit(0).alias("start_byte"),
        F.octet_length("text").alias("end_byte"), F.lit(1).alias("start_line"),
        F.size(text.split_lines("text")).alias("end_line"), F.array(paths.file_name("path")).alias("heading_path"))
    return headed.unionByName(whole)


def outline(sections: DataFrame) -> DataFrame:
    """Indented headings of each file with their line ranges."""
    line = F.concat(F.repeat(F.lit("  "), F.col("heading_level") - 1), F.lit("# "), "heading",
                    F.format_string(" (L%d-L%d)", F.col("start_line"), F.col("end_line")))
    rows = sections.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", line.alias("line")))).alias("_l"))
    return rows.select("path", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("skeleton"))
