"""Symbols and references of brace-language files (Java, Kotlin, Swift) as a Spark job.

Files are split by path once; tokens stay with their file, so every window below runs inside
one file (whose size discovery bounds) without another shuffle:

  tokens      one regular expression cuts the text; running sums give offsets, lines, nesting
  contexts    tokens grouped by the bracket they sit in, bracket pairs seen from outside as two
  statements  runs of tokens of one context; their joined shape is matched against declarations
"""

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom import constants as C
from codeloom.functions import identifiers as ident
from codeloom.operators.lineage import materialize
from codeloom.operators.spans import enclosing
from codeloom.operators.statements import statements
from codeloom.sources import grammar as G

LANGUAGES = ("java", "kotlin", "swift")
RUNNING = (Window.unboundedPreceding, Window.currentRow)


def per_language(patterns: dict, build) -> Column:
    out = None
    for language, pattern in patterns.items():
        hit = F.col("language") == language
        out = F.when(hit, build(pattern)) if out is None else out.when(hit, build(pattern))
    return out


def source_text(content) -> Column:
    return F.make_valid_utf8(F.col(content).cast("string"))


def byte_slice(content, start, end) -> Column:
    return F.substring(F.col(content), start + 1, end - start).cast("string")


def tokens(files: DataFrame) -> DataFrame:
    """Tokens with byte and line positions and the level of their bracket context."""
    # an explicit count: token rows outgrow the text, so partitions must not shrink to the text's size
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = files.repartition(spread, "path").select(
        "path", "language", F.posexplode(F.regexp_extract_all(source_text("content"), F.lit(G.TOKEN), F.lit(0))).alias("pos", "tok"))
    order = Window.partitionBy("path").orderBy("pos").rowsBetween(*RUNNING)
    breaks = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    opens, closes = F.col("tok").isin("(", "[", "{"), F.col("tok").isin(")", "]", "}")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    first = F.substring("tok", 1, 1)
    kind = (F.when(F.col("tok").rlike(r"^\s"), "space").when(F.col("tok").rlike(r"^/[*/]"), "comment")
            .when(first.isin('"', "'"), "string").when(F.col("tok").rlike(r"^[\p{L}_$`]"), "name")
            .when(F.col("tok").rlike(r"^\p{N}"), "number").otherwise("sign"))
    return (cut.withColumn("_breaks", breaks).withColumn("kind", kind)
            .withColumn("end_byte", F.sum(F.octet_length("tok")).over(order).cast("int"))
            .withColumn("_line", F.sum("_breaks").over(order).cast("int"))
            .withColumn("inner", F.sum(step).over(order).cast("int"))
            .where(F.col("kind") != "space")
            .select("path", "language", "pos", F.col("kind"),
                    F.when(F.col("tok").startswith("`"), F.translate("tok", " ", "_")).otherwise(F.col("tok")).alias("tok"),
                    (F.col("end_byte") - F.octet_length("tok")).alias("start_byte"), "end_byte",
                    (F.col("_line") - F.col("_breaks") + 1).alias("start_line"), (F.col("_line") + 1).alias("end_line"),
                    F.when(opens, F.col("inner") - 1).otherwise(F.col("inner")).alias("level"), "inner", opens.alias("is_open")))


def syntax_errors(toks: DataFrame) -> DataFrame:
    """Unbalanced brackets per file."""
    last = F.max_by("inner", "pos")
    below = F.greatest(F.lit(0), -F.least(F.min("inner"), F.lit(0)))
    return toks.groupBy("path").agg((below + F.greatest(F.lit(0), last + below)).cast("int").alias("parse_error_count"))


def _nth_item(n) -> Column:
    return F.try_element_at("items", n + 1)


def declarations(stmts: DataFrame) -> DataFrame:
    """Statements reduced to what they declare (``what`` is null for none) and the calls they hold."""
    def group(patterns, n, needs):
        # a shape is matched only if it holds what every match of the pattern holds
        return F.when(needs, per_language(patterns, lambda p: F.regexp_extract("shape", p, n))).otherwise("")
    typed = functools.reduce(lambda a, b: a | b, (F.contains("shape", F.lit(word + " ")) for word in G.TYPE_WORDS))
    called = F.contains("shape", F.lit(" ( )")) & ((F.col("language") != "java") | F.endswith("shape", F.lit("{ }")) | F.endswith("shape", F.lit(";")))
    initial = F.contains("shape", F.lit("constructor")) | F.contains("shape", F.lit("init"))
    rows = (stmts.withColumn("t_head", group(G.TYPE_SHAPES, 1, typed))
            .withColumn("t_word", F.substring_index(F.rtrim("t_head"), " ", -1))
            .withColumn("t_name", group(G.TYPE_SHAPES, 3, F.col("t_head") != ""))
            .withColumn("f_name", group(G.FUNCTION_SHAPES, 2, called))
            .withColumn("f_head", group(G.FUNCTION_SHAPES, 1, F.col("f_name") != ""))
            .withColumn("c_name", F.coalesce(group(G.CONSTRUCTOR_SHAPES, 2, initial), F.lit("")))
            .withColumn("c_head", group(G.CONSTRUCTOR_SHAPES, 1, F.col("c_name") != "")))
    bare = F.trim(F.regexp_replace(F.regexp_replace("f_head", rf"@ {G.NAME}(?: \. {G.NAME})*(?: ~ ~)? ", ""),
                                   r"\b(" + "|".join(G.MODIFIERS["java"]) + r") ", ""))
    # type parameters alone (before a constructor) are no return type
    java_type = F.trim(F.regexp_replace(bare, r"^<[^<>]*(?:<[^<>]*>[^<>]*)*>$", ""))
    has_body = F.endswith("shape", F.lit("{ }"))
    java_function = ((F.col("language") == "java") & (F.col("f_name") != "") & ~F.col("f_name").isin(*G.NOT_CALLS["java"])
                     & ~F.endswith(F.trim("f_head"), F.lit("."))
                     & ~F.regexp_extract(bare, rf"^({G.NAME})", 1).isin("return", "new", "throw", "else", "assert", "yield", "case", "package", "import")
                     & ((java_type != "") | has_body))
    is_type = (F.col("t_word") != "") & ((F.col("language") != "java") | F.contains("shape", F.lit("{")))
    companion = F.col("t_head").rlike(r"(^| )companion ") & (F.col("t_word") == "object")
    anonymous = (F.col("t_name") == "") & ~companion
    what = (F.when(is_type & ~anonymous, F.when(F.col("t_word").isin("extension", "actor"), "extension").otherwise("type"))
            .when(is_type, F.lit(None))
            .when(F.col("c_name") != "", "constructor")
            .when(java_function, F.when(java_type == "", "constructor").otherwise("function"))
            .when((F.col("language") != "java") & (F.col("f_name") != ""), "function"))
    head = F.when(F.col("_what").isin("type", "extension"), F.col("t_head")).when(
        F.col("c_name") != "", F.col("c_head")).otherwise(F.col("f_head"))
    # exploded, so that the filter stays above and matches no shape a second time
    rows = rows.withColumn("_what", what).withColumn("_what", F.explode(F.array("_what"))).where(F.col("_what").isNotNull() | (F.size("calls") > 0)).withColumn("_head", head)
    at = F.length("_head") - F.length(F.replace("_head", F.lit(" "), F.lit("")))
    name = (F.when(F.col("_what").isin("type", "extension"), F.when(companion, "Companion").otherwise(F.col("t_name")))
            .when(F.col("c_name") != "", F.col("c_name")).otherwise(F.translate("f_name", "`", "")))
    rows = rows.withColumn("name_at", at).withColumn("name", name)
    # items are looked through for declarations only
    rows = rows.withColumn("name_pos", F.when(F.col("_what").isNotNull(), _nth_item(F.col("name_at"))["pos"]))
    after = F.filter("items", lambda t: t["pos"] > F.coalesce("name_pos", F.lit(-1)))
    rows = rows.withColumn("_after", F.when(F.col("_what").isNotNull(), after))

    def first_after(tok):
        return F.try_element_at(F.filter("_after", lambda t: t["tok"] == tok), F.lit(1))
    by_value = F.when((F.col("language") == "kotlin") & (F.col("_what") == "function"), first_after("="))
    expression = F.col("_value").isNotNull() & (F.col("_body").isNull() | (F.col("_value.pos") < F.col("_body.pos")))
    last, start = F.element_at("items", -1), F.element_at("items", 1)
    parens = F.when(F.col("_what").isin("function", "constructor") & (F.col("language") != "swift"),
                    first_after("("))
    receiver_type = F.nullif(F.regexp_extract("f_head", rf"({G.NAME})(?: <[^.]*>)?(?: \?)? \. $", 1), F.lit(""))
    receiver_type = F.when((F.col("language") == "kotlin") & (F.col("_what") == "function"), receiver_type)
    modified = F.regexp_extract("_head", r"(?:^| )(enum|annotation|companion) (?:class|object) $", 1)
    modified = F.when(F.col("_what") == "type", F.nullif(modified, F.lit("")))
    inside = (F.when(F.col("_what").isNull(), F.col("calls"))
              .when(F.col("_what").isin("function", "constructor"), F.filter("calls", lambda t: t["pos"] > F.col("body_pos")))
              .otherwise(F.slice("calls", 1, 0)))
    header = F.when(F.col("_what").isin("type", "extension"), F.filter("items", lambda t: (
        t["pos"] > F.col("name_pos")) & (F.col("body_pos").isNull() | (t["pos"] < F.col("body_pos")))))
    return (rows.withColumn("_body", first_after("{")).withColumn("_value", by_value).withColumn("_expr", expression)
            .withColumn("_last", last).withColumn("_start", start).withColumn("_parens", parens)
            .withColumn("body_pos", F.when(F.col("_expr"), F.col("_value.pos")).otherwise(F.col("_body.pos")))
            .select("path", "language", "ctx", "stmt", "name", F.col("_what").alias("what"), "t_word", "body_pos",
                    _clean_comments(F.when(F.col("_what").isNotNull(), F.array_join("comments", "\n"))).alias("docstring"),
                    header.alias("header"), inside.alias("calls"), receiver_type.alias("receiver_type"), modified.alias("modified"),
                    F.col("_start.start_byte").alias("start_byte"), F.col("_start.start_line").alias("start_line"),
                    F.when(F.col("_expr"), F.col("_last.end_byte")).when(F.col("_body").isNotNull(), F.col("_body.pair_end"))
                    .otherwise(F.col("_last.end_byte")).alias("end_byte"),
                    F.when(F.col("_expr"), F.col("_last.end_line")).when(F.col("_body").isNotNull(), F.col("_body.pair_line"))
                    .otherwise(F.col("_last.end_line")).alias("end_line"),
                    F.when(F.col("_expr"), F.col("_value.start_byte")).otherwise(F.col("_body.start_byte")).alias("body_start_byte"),
                    F.when(F.col("_expr"), F.col("_last.end_byte")).otherwise(F.col("_body.pair_end")).alias("body_end_byte"),
                    F.col("_parens.start_byte").alias("_p1"), F.col("_parens.pair_end").alias("_p2")))


def _clean_comments(raw: Column) -> Column:
    """Comment text without its markers."""
    block = F.regexp_replace(F.regexp_replace(raw, r"(?s)^/\*|\*/$", ""), r"(?m)^[^\S\n]*\*[^\S\n]?", "")
    lines = F.regexp_replace(raw, r"(?m)^[^\S\n]*///?[^\S\n]?", "")
    text = F.when(raw.rlike(r"(?s)^/\*.*\*/$"), block).otherwise(lines)
    trimmed = F.regexp_replace(text, r"^\s+|\s+\z", "")
    return F.when(trimmed != "", trimmed)


def package_of(content) -> Column:
    text = source_text(content)
    return (F.when(F.col("language") == "java", F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1))
            .when(F.col("language") == "kotlin", F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)", 1))
            .otherwise(""))


def parse(files: DataFrame, backend: str = "nested"):
    """(symbols, references, errors) of Java, Kotlin and Swift files with ``content``.

    The text is cut once; what it declares and calls is written before the joins below. The
    ``flat`` backend names Java and Kotlin symbols without nesting: types belong to the package
    and keep their declaring words as kind, Java methods belong to the last type of the file,
    Kotlin functions to their receiver type or innermost type.
    """
    files = files.where(F.col("language").isin(*LANGUAGES))
    toks = tokens(files)
    found = materialize(declarations(statements(files, source_text("content"))))
    texts = files.select("path", "content")
    owned = _owned_flat(found) if backend == "flat" else _owned(found)
    return _symbols(owned, files), _references(found, texts), syntax_errors(toks)


def _declared(found: DataFrame) -> DataFrame:
    return found.where(F.col("what").isNotNull() & (F.col("what") != "extension")).drop("header", "calls", "ctx", "stmt")


def _owned(found: DataFrame) -> DataFrame:
    """Declarations with the innermost declaration around each."""
    named = _declared(found)
    owned = enclosing(named, named, "parent", F.struct(F.col("start_byte").alias("byte"), "name"), outside_own=True)
    # a Java constructor carries the name of its class; anything else of that shape is a call with a body
    owned = owned.where(~((F.col("language") == "java") & (F.col("what") == "constructor"))
                        | (F.col("name") == F.col("parent.name")))
    return owned.withColumn("raw_kind", F.lit(None).cast("string"))


def _owned_flat(found: DataFrame) -> DataFrame:
    """Declarations with the owners of the flat backend; Swift keeps the nested ones."""
    nested = _owned(found)
    types = _declared(found).where(F.col("what") == "type")
    payload = F.struct(F.col("start_byte").alias("byte"), "name")
    functions = nested.where(F.col("what") != "type").drop("parent")
    last = types.groupBy("path").agg(F.max_by(payload, "start_byte").alias("parent"))
    java = functions.where(F.col("language") == "java").join(last, "path", "left")
    kotlin = functions.where((F.col("language") == "kotlin") & (F.col("what") == "function"))
    kotlin = enclosing(kotlin, types, "parent", payload)
    extended = F.struct(F.lit(None).cast("int").alias("byte"), F.col("receiver_type").alias("name"))
    kotlin = kotlin.withColumn("parent", F.when(F.col("receiver_type").isNotNull(), extended).otherwise(F.col("parent")))
    words = F.when((F.col("language") == "kotlin") & F.col("modified").isNotNull(), F.concat("modified", F.lit(" "), "t_word")).otherwise(F.col("t_word"))
    flat = (nested.where((F.col("what") == "type") & (F.col("language") != "swift"))
            .withColumn("parent", F.lit(None).cast(nested.schema["parent"].dataType)).withColumn("raw_kind", words))
    swift = nested.where(F.col("language") == "swift")
    columns = nested.columns
    return flat.select(columns).unionByName(java.select(columns)).unionByName(kotlin.select(columns)).unionByName(swift)


def _symbols(owned: DataFrame, files: DataFrame) -> DataFrame:
    owned = owned.join(files.select("path", "content", package_of("content").alias("package")), "path")
    params = F.when(F.col("_p1").isNotNull(), byte_slice("content", F.col("_p1") + 1, F.col("_p2") - 1))
    upto = F.coalesce("body_start_byte", "end_byte")
    signature = F.regexp_replace(byte_slice("content", F.col("start_byte"), upto), r"^\s+|\s+\z", "")
    owned = (owned.withColumn("params", F.regexp_replace(params, r"^\s+|\s+\z", ""))
             .withColumn("signature", F.when(F.col("body_start_byte").isNull(), F.regexp_replace(signature, r"\s*;+\z", ""))
                         .otherwise(signature)).drop("content"))
    inside = F.col("parent").isNotNull()
    kind = (F.when(F.col("raw_kind").isNotNull(), F.col("raw_kind"))
            .when((F.col("language") == "kotlin") & (F.col("what") == "type"), "class")
            .when(F.col("what") == "type", functools.reduce(
                lambda acc, kv: acc.when(F.col("t_word") == kv[0], kv[1]), list(G.KINDS.items())[1:],
                F.when(F.col("t_word") == "class", "class")))
            .when(inside, "method").otherwise(F.col("what")))
    owner = F.when(inside, F.col("parent.name")).otherwise(F.col("package"))
    keyed = owned.withColumn("kind", kind).withColumn("owner", owner).withColumn(
        "qualified_name", F.when(F.col("owner") != "", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name")))
    keyed = materialize(keyed.withColumn("symbol_key", ident.symbol_key("language", "path", "owner", "name", "params", "start_line")))
    parents = keyed.select("path", F.col("start_byte").alias("_pb"), F.col("symbol_key").alias("parent_key"))
    return (keyed.withColumn("_pb", F.col("parent.byte")).join(parents, ["path", "_pb"], "left")
            .select("path", "language", "name", "qualified_name", "kind", "signature", "docstring", "parent_key", "symbol_key",
                    "start_byte", "end_byte", "start_line", "end_line", "body_start_byte", "body_end_byte"))


def _references(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Calls, instantiations and supertypes with their receiver text; enclosing symbols come later."""
    # the first statement of a Java enum body lists its constants
    enums = found.where((F.col("language") == "java") & (F.col("t_word") == "enum")).select(
        "path", F.col("body_pos").alias("ctx"), F.lit(1).cast("long").alias("stmt"))
    calls = (found.join(enums, ["path", "ctx", "stmt"], "left_anti")
             .select("path", "language", F.explode("calls").alias("c")).select("path", "language", "c.*").drop("pos"))
    every = calls.unionByName(_supertypes(found)).where(~F.col("spelling").isin(*C.REFERENCE_STOPLIST))
    sliced = F.regexp_replace(byte_slice("content", F.col("start_byte"), F.col("upto")), r"^\s+|\s+\z", "")
    return every.join(texts, "path").select(
        "path", "language", "spelling", "role", "start_byte", "end_byte", "start_line", "end_line",
        F.when(F.col("upto").isNotNull(), sliced).alias("receiver"))


def _supertypes(found: DataFrame) -> DataFrame:
    """Names in the supertype list of a type header."""
    header = found.where(F.col("header").isNotNull()).select(
        "path", "language", "ctx", "stmt", "t_word", F.explode("header").alias("t")).select("*", "t.*").drop("t")
    order = Window.partitionBy("path", "ctx", "stmt").orderBy("pos")
    run = order.rowsBetween(*RUNNING)
    section = F.when(F.col("language") == "java", F.when(F.col("tok").isin("extends", "implements", "permits"), F.col("tok"))).otherwise(
        F.when(F.col("tok") == ":", "list").when(F.col("tok") == "where", "where"))
    angle = F.sum(F.when(F.col("tok") == "<", 1).when(F.col("tok") == ">", -1).otherwise(0)).over(run)
    header = (header.withColumn("p1", F.lag("tok").over(order)).withColumn("n1", F.lead("tok").over(order))
              .withColumn("_angle", angle).withColumn("_section", F.last(section, ignorenulls=True).over(run)))
    header = header.where(F.col("_angle") == 0).withColumn(
        "_entry", F.sum(F.when(F.col("tok") == ",", 1).otherwise(0)).over(run))
    entry = Window.partitionBy("path", "ctx", "stmt", "_section", "_entry")
    header = (header.withColumn("_called", F.max(F.col("tok") == "(").over(entry))
              .withColumn("_delegated", F.max(F.col("tok") == "by").over(entry)))
    is_name = (F.col("kind") == "name") & ~F.col("tok").isin("extends", "implements", "permits", "where", "by", "class")
    simple = ~F.coalesce(F.col("p1") == ".", F.lit(False)) & ~F.coalesce(F.col("n1").isin(".", "<"), F.lit(False))
    java = (F.col("language") == "java") & simple & (
        ((F.col("_section") == "extends") & (F.col("t_word") == "class"))
        | ((F.col("_section") == "implements") & (F.col("t_word") != "interface")))
    tail = ~F.coalesce(F.col("n1") == ".", F.lit(False)) & (F.col("_section") == "list")
    kotlin = (F.col("language") == "kotlin") & tail & ~F.col("_delegated")
    swift = (F.col("language") == "swift") & tail
    role = (F.when(F.col("language") == "java", F.col("_section"))
            .when((F.col("language") == "kotlin") & F.col("_called"), "extends").otherwise("implements"))
    return header.where(is_name & (java | kotlin | swift)).select(
        "path", "language", F.col("tok").alias("spelling"), role.alias("role"), "start_byte", "end_byte", "start_line", "end_line",
        F.lit(None).cast("int").alias("upto"))


def enclose_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with the key of their symbol: the function around a call, else any symbol around it."""
    key = F.col("symbol_key")
    functions = symbols.where(F.col("kind").isin("method", "function", "constructor"))
    inner = enclosing(materialize(references), symbols, "_any", key)
    inner = enclosing(materialize(inner), functions, "_function", key)
    typed = F.col("role").isin("extends", "implements")
    return inner.withColumn("enclosing_key", F.when(typed, F.col("_any")).otherwise(
        F.coalesce("_function", "_any"))).drop("_any", "_function")
