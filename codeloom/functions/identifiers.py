"""Scalar expressions over identifiers and symbol keys."""

from pyspark.sql import Column, functions as F

from codeloom.functions.like import _col

WORD_PATTERN = r"(?U)([A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|\d+)"
MENTION_PATTERN = r"(?U)\b([A-Z][a-zA-Z0-9_]+)\b"
PARAM_SUFFIX = r"\([^)]*\)\s*$"
LINE_SUFFIX = r"@L\d+\s*$"


def symbol_key(language, path, owner, name, params=None, line=None) -> Column:
    """``<language>://<path>[::owner]#name[(params)][@Lline]``."""
    clean = F.regexp_replace(F.translate(_col(path), "\\", "/"), "^/+|/+$", "")
    owner, params, line = (
        F.lit(None).cast("string") if c is None else _col(c) for c in (owner, params, line)
    )
    return F.concat(
        _col(language), F.lit("://"), clean,
        F.when(F.coalesce(owner, F.lit("")) != "", F.concat(F.lit("::"), owner)).otherwise(""),
        F.lit("#"), _col(name),
        F.when(params.isNotNull(), F.concat(F.lit("("), params, F.lit(")"))).otherwise(""),
        F.when(F.coalesce(line.cast("long"), F.lit(0)) != 0,
               F.concat(F.lit("@L"), line.cast("string"))).otherwise(""),
    )


def parse_symbol_query(query) -> Column:
    """Split a URI, dotted or bare query into language, path_or_owner, name and raw."""
    raw = F.trim(_col(query))
    is_uri, is_dotted = F.contains(raw, F.lit("://")), F.contains(raw, F.lit("."))
    rest = F.regexp_replace(raw, r"^(?s).*?://", "")
    before_hash = F.when(
        F.contains(rest, F.lit("#")), F.regexp_extract(rest, r"(?s)^(.*)#", 1)).otherwise("")
    after_hash = F.substring_index(rest, "#", -1)
    owner = F.regexp_extract(raw, r"(?s)^(.*)\.", 1)
    tail = F.when(is_uri, after_hash).otherwise(F.substring_index(raw, ".", -1))
    return F.struct(
        F.when(is_uri, F.substring_index(raw, "://", 1)).alias("language"),
        F.when(is_uri, before_hash).when(is_dotted, owner).alias("path_or_owner"),
        F.substring_index(tail, "(", 1).alias("name"),
        raw.alias("raw"),
    )


def identifier_tokens(identifier) -> Column:
    """Lower-case words of a camelCase, PascalCase, snake_case or kebab-case identifier."""
    def words(part):
        found = F.regexp_extract_all(part, F.lit(WORD_PATTERN), F.lit(1))
        return (F.when(F.size(found) > 0, F.transform(found, F.lower))
                .when(part != "", F.array(F.lower(part)))
                .otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(F.split(_col(identifier), "[-_]+"), words))


def normalize_lookup(query) -> Column:
    """Drop a trailing parameter list, then a trailing line anchor."""
    no_params = F.trim(F.regexp_replace(_col(query), PARAM_SUFFIX, ""))
    return F.trim(F.regexp_replace(no_params, LINE_SUFFIX, ""))


def camel_mentions(text) -> Column:
    """Distinct capitalised identifiers mentioned in a text."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(MENTION_PATTERN), F.lit(1)))
