"""Resolution of occurrences to symbols, and the call and type edges that follow.

An occurrence resolves by the first rule that applies:
  same file     exactly one symbol of that name in the file          class-scoped
  receiver      exactly one symbol of that name whose qualified name
                or key contains the receiver text                    import-scoped
  repository    one symbol of that name                              probable
                several: the first by path and position              ambiguous
Every rule joins occurrences with symbols already reduced to one row per join key, so no
step emits the pairs of a name's occurrences and symbols.
"""

import functools

from pyspark.sql import DataFrame, functions as F

from codeloom import constants as C
from codeloom.functions.like import contains_like
from codeloom.operators.lineage import materialize
from codeloom.operators.skew import salted_left_join

DIRECT = 256   # a name with more symbols and more distinct receivers than this uses the substring index


def _first_symbol():
    return F.min(F.struct("path", "start_byte", "symbol_key", "sym_id"))["sym_id"]


def receiver_matches(pairs: DataFrame, symbols: DataFrame, direct=DIRECT) -> DataFrame:
    """Per distinct (spelling, receiver): how many symbols match, and the only one."""
    # comparing costs at most DIRECT rows per symbol or per receiver while either side is small
    many_symbols = symbols.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") > direct)
    many_receivers = (pairs.groupBy(F.col("spelling").alias("name")).agg(F.count("*").alias("_r"))
                      .where(F.col("_r") > direct))
    crowded = many_symbols.join(many_receivers, "name").select("name")
    if crowded.isEmpty():
        return _compared_matches(pairs, symbols)
    small = symbols.join(crowded, "name", "left_anti")
    large = symbols.join(crowded, "name", "left_semi")
    return _compared_matches(pairs, small).unionByName(_indexed_matches(pairs, large))


def _compared_matches(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Comparison of the receivers and symbols of a name, of which one side is small."""
    return (
        pairs.join(symbols.select(F.col("name").alias("spelling"), "qualified_name", "symbol_key",
                                  "path", "start_byte", "sym_id"), "spelling")
        .where(contains_like("qualified_name", "receiver") | contains_like("symbol_key", "receiver"))
        .groupBy("spelling", "receiver")
        .agg(F.count("*").alias("recv_n"), _first_symbol().alias("recv_sym")))


def _masked(text, shape):
    """Text with the shape's wildcard positions blanked out."""
    return F.when(F.contains(shape, F.lit("_")), F.array_join(F.zip_with(
        F.split(text, ""), F.split(shape, ""),
        lambda c, m: F.when(m == "_", "_").otherwise(c)), "")).otherwise(text)


def _indexed_matches(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same result for names with very many symbols, through an index of substrings.

    Each such symbol lists its substrings of the lengths (and ``_`` positions) that receivers
    of its name ask for. Work grows with symbols times text length, never with pairs.
    """
    hot_names = symbols.select(F.col("name").alias("spelling")).distinct()
    wanted = (pairs.join(hot_names, "spelling", "left_semi")
              .withColumn("_low", F.lower("receiver"))
              # the longest run between "%" decides the candidates
              .withColumn("_seg", F.array_sort(
                  F.split("_low", "%"),
                  lambda a, b: F.length(b) - F.length(a))[0])
              .withColumn("_shape", F.regexp_replace("_seg", "[^_]", "x")))
    shapes = wanted.select(F.col("spelling").alias("name"), "_shape").distinct()
    size = F.length("_shape")

    def windows(column):
        text = F.lower(column)
        last = F.length(text) - size + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
            F.array().cast("array<int>"))
        return F.coalesce(
            F.transform(starts, lambda i: _masked(F.substring(text, i, size), F.col("_shape"))),
            F.array().cast("array<string>"))

    grams = (symbols.join(shapes, "name")
             .withColumn("_seg", F.explode(F.array_union(windows(F.col("qualified_name")),
                                                         windows(F.col("symbol_key")))))
             .select(F.col("name").alias("spelling"), "_shape", "_seg", "qualified_name",
                     "symbol_key", "path", "start_byte", "sym_id"))
    asked = wanted.select("spelling", "_shape", "_seg").distinct()
    grams = grams.join(asked, ["spelling", "_shape", "_seg"], "left_semi")

    reduced = (grams.groupBy("spelling", "_shape", "_seg")
               .agg(F.count("*").alias("recv_n"), _first_symbol().alias("recv_sym")))
    plain = (wanted.where(~F.contains("_low", F.lit("%")))
             .join(reduced, ["spelling", "_shape", "_seg"])
             .select("spelling", "receiver", "recv_n", "recv_sym"))
    # receivers holding "%" check the whole pattern on the symbols their longest run selects
    several = (wanted.where(F.contains("_low", F.lit("%")))
               .join(grams, ["spelling", "_shape", "_seg"])
               .where(contains_like("qualified_name", "receiver") | contains_like("symbol_key", "receiver"))
               .groupBy("spelling", "receiver")
               .agg(F.count("*").alias("recv_n"), _first_symbol().alias("recv_sym")))
    return plain.unionByName(several)


def resolve_occurrences(occurrences: DataFrame, symbols: DataFrame, direct=DIRECT) -> DataFrame:
    """Occurrences with ``target_id``, ``resolution_kind`` and ``confidence``.

    All but the first rule depend on spelling and receiver only, so they are settled once for every distinct pair. The table of these, and that of names which are single
    in their file, meet the occurrences; the occurrences move only where one of the two is large.
    """
    receiver = F.coalesce(F.col("receiver"), F.lit(""))
    pair = F.struct("spelling", receiver.alias("receiver"))
    asked = materialize(occurrences.groupBy(pair.alias("_pair")).agg(F.count("*").alias("_n")))
    names = asked.select(F.col("_pair.spelling").alias("name")).distinct()
    named = symbols.select("name", "path", "start_byte", "symbol_key", "sym_id", "qualified_name").join(names, "name", "left_semi")
    alone = materialize(named.groupBy("path", F.col("name").alias("spelling")).agg(F.count("*").alias("_n"), F.min("sym_id").alias("file_sym"))
                        .where("_n = 1").drop("_n"))
    overall = named.groupBy(F.col("name").alias("spelling")).agg(
        F.count("*").alias("repo_n"), _first_symbol().alias("repo_sym"))
    pairs = asked.select("_pair.*")
    by_receiver = receiver_matches(pairs.where("receiver <> ''"), named, direct)
    found = pairs.join(overall, "spelling", "left").join(by_receiver, ["spelling", "receiver"], "left")
    by_pair = materialize(found.select(
        F.struct("spelling", "receiver").alias("_pair"),
        F.when(F.col("recv_n") == 1, 1).when(F.col("repo_n") == 1, 2).when(F.col("repo_n") > 1, 3).alias("_rule"),
        F.when(F.col("recv_n") == 1, F.col("recv_sym")).otherwise(F.col("repo_sym")).alias("_sym")).where("_rule is not null"))

    joined = salted_left_join(occurrences.withColumn("_pair", pair), by_pair, "_pair", counts=asked)
    joined = joined.join(alone, ["path", "spelling"], "left")
    rules = [F.col("file_sym").isNotNull()] + [F.col("_rule") == i for i in (1, 2, 3)]

    def pick(values):
        return functools.reduce(lambda out, rule: out.when(*rule), list(zip(rules, values))[1:], F.when(rules[0], values[0]))

    kinds = [C.CLASS_SCOPED, C.IMPORT_SCOPED, C.PROBABLE, C.AMBIGUOUS]
    return joined.select(
        *occurrences.columns,
        F.coalesce("file_sym", "_sym").alias("target_id"),
        F.coalesce(pick([F.lit(k) for k, _ in kinds]), F.lit(C.UNRESOLVED)).alias("resolution_kind"),
        pick([F.lit(c) for _, c in kinds]).cast("double").alias("confidence"))


def derive_edges(resolved: DataFrame) -> DataFrame:
    """One edge per resolved occurrence that sits inside a symbol."""
    kind = F.when(F.col("role").isin("implements", "extends"), F.col("role")).otherwise("calls")
    return (resolved.where(F.col("target_id").isNotNull() & F.col("enclosing_id").isNotNull())
            .select(F.col("enclosing_id").alias("source_id"), "target_id", "occ_id",
                    kind.alias("kind"), "resolution_kind", "confidence"))
