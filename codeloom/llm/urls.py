"""URL filters whose decisions reach all aliases of a page. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.components import components
from codeloom.llm.storage import materialize

MAX_RULES = 1000   # literal rules of one expression
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
CANONICAL = r"(?is)<link\b(?=[^>]*?\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?[\d.\s]*[;,]?\s*url\s*=\s*'?([^\"'\s>]+)"


def parsed(df: DataFrame, url: str, host: str, path: str, key: str) -> DataFrame:
    """Adds what a URL has after its first ``://``: ``host`` (A-Z in lower case), ``path``, both empty without ``://``, and ``key``, which tells URLs
    apart as nodes: host, path and query, null without a host. In steps, so that none is computed twice."""
    at = F.instr(F.col(url), "://")
    df = df.withColumn("__rest", F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))), F.lit("")))
    df = df.withColumns({host: F.translate(F.regexp_extract("__rest", "^[^/?#]*", 0), UPPER, LOWER), path: F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1),
                         "__query": F.regexp_extract("__rest", r"^[^?#]*(\?[^#]*)?", 1)})
    return df.withColumn(key, F.when(F.col(host) != "", F.concat(host, path, "__query"))).drop("__rest", "__query")


def decision(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(length, host's length, verdict, rule) of the longest of ``rules`` (verdict, host, path) that fits, or null. Of equally long ones
    that of the longer host, then allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(len(h)).alias("host_length"), F.lit(verdict == "allow").alias("allow"),
                            F.lit(h + p).alias("rule"))) for verdict, h, p in rules]
    none = F.lit(None).cast("struct<length:int,host_length:int,allow:boolean,rule:string>")
    return F.array_max(F.array(none, *fits))


def without_dots(path: Column) -> Column:
    """A path from the root without its segments ``.`` and ``..``."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: F.when(part == ".", done).when(
        part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part))))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.contains("/."), F.concat(joined, F.when(last.isin(".", "..") & (joined != "/"), "/").otherwise(""))).otherwise(path)


def resolved(df: DataFrame, base: str, link: str) -> DataFrame:
    """``df`` with the column ``link`` made absolute: what names a scheme and a host stays; others are taken from the URL ``base``, by the scheme,
    the host's root, the folder or the page. Null if another scheme has no host (``mailto:``) or the base has none."""
    to, scheme = F.col(link), F.regexp_extract(base, "^[^:/?#]*", 0)
    root = F.regexp_extract(base, "^[^:/?#]*://[^/?#]+", 0)
    rest = F.substring(F.col(base), F.length(root) + 1, F.length(base))
    path, query = F.regexp_extract(rest, "^[^?#]*", 0), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)
    to_path, tail = F.regexp_extract(to, "^[^?#]*", 0), F.regexp_extract(to, "^[^?#]*(.*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    there = F.when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(root, without_dots(to_path), tail)).when(
        to.startswith("?"), F.concat(root, path, to)).when(to.startswith("#"), F.concat(root, path, query, to)).otherwise(
        F.concat(root, without_dots(F.concat(folder, to_path)), tail))
    return df.withColumn(link, F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (root != ""), there))


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): keys of pages and of what their canonical links and refresh redirects name. Links that are not absolute are
    resolved against the page's URL, or against the first ``base`` of the page; those without a host (``mailto:``) name no page."""
    text = F.col(html)
    links = F.filter(F.array(*[F.when(text.rlike(f"(?i){word}"), F.regexp_extract(text, pattern, 1))
                               for word, pattern in (("canonical", CANONICAL), ("refresh", REFRESH))]), lambda x: x != "")
    own = F.when(text.rlike("(?i)<base"), F.nullif(F.regexp_extract(text, BASE, 1), F.lit("")))
    found = pages.select(F.col(url).alias("url"), F.explode(links).alias("link"), own.alias("base"))
    found = materialize(found.withColumns({c: F.replace(c, F.lit("&amp;"), F.lit("&")) for c in ("link", "base")}))
    # written after each step: a filter that moves down through the steps would repeat their expressions in each other
    found = materialize(resolved(found, "url", "base").withColumn("base", F.coalesce("base", "url")))
    found = materialize(resolved(found, "base", "link").select("url", "link"))
    return parsed(parsed(found, "url", "host", "path", "source"), "link", "h", "p", "target").where("source <> target").select("source", "target")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """One row per page: ``id`` under its own name, ``host``, ``path``, ``rule`` (of the longest that fits, else null), ``verdict`` (allow or block) and
    ``alias_of_blocked``.

    ``rules`` are (verdict, host, path). A page that a rule fits has the rule's verdict. Others take part in what is decided about their
    aliases: URLs are nodes, redirects (``redirects``: ``source`` and ``target`` URLs) and canonical links or refreshes in ``html`` are edges, and of each
    connected component the rules' verdicts on all its URLs, crawled or not, are gathered: an explicit allow precedes, a block
    holds otherwise, and with neither the page is allowed.

    A null URL or one without ``://`` has an empty host and path, fits no rule, is no node and is allowed. Null html has no links. Repeated rows are
    kept; columns of other names are ignored. URLs are equal as nodes by host in lower case, path and query. Very long pages are searched whole; without pages there are no
    rows. Of rules that fit equally well the one of the longer host holds, then allow.
    """
    edges = edges_of(pages, url, html)
    if redirects is not None:
        more = redirects.select(F.col("source").alias("a"), F.col("target").alias("b"))
        more = parsed(parsed(more, "a", "h", "p", "source"), "b", "h", "p", "target")
        edges = edges.union(more.where("source <> target").select("source", "target"))
    nodes = components(edges, "source", "target").withColumn("url", F.concat(F.lit("://"), "node"))
    nodes = materialize(parsed(nodes, "url", "host", "path", "key"))
    fit = nodes.select("component", decision(F.col("host"), F.col("path"), rules).alias("d")).where("d is not null")
    decided = fit.groupBy("component").agg(F.max("d.allow").alias("by_alias"))
    aliases = materialize(nodes.join(decided, "component").select("node", "by_alias"))
    own = decision(F.col("host"), F.col("path"), rules)
    # written, so that the parsed columns are columns in the rules' expression and are not parsed again for each rule
    out = parsed(pages.select(F.col(id).alias("__id"), F.col(url).alias("__url")), "__url", "host", "path", "node")
    out = materialize(out.select("__id", "host", "path", "node"))
    out = out.withColumn("own", own).join(aliases, "node", "left")
    blocked = F.coalesce(~F.col("by_alias"), F.lit(False))
    allow = F.coalesce("own.allow", ~blocked)
    return out.select(F.col("__id").alias(id), "host", "path", F.col("own.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"),
                      (F.col("own").isNull() & blocked).alias("alias_of_blocked"))
