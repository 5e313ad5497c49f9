"""URL filter: longest-prefix host rules, then block decisions spread over redirect and canonical-link aliases.

Built-in column expressions only. Urls are vertices; an edge joins a page's url with the target of its
canonical link, og:url or meta refresh. One large alias group is handled by the distributed components
in :mod:`inkspan.llm.components`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fields, numbered
from inkspan.llm.components import connected_components

#: (action, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; '' for null or without ``://``."""
    rest = _rest(url)
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    return F.when(_has_scheme(url), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' for null or without ``://``."""
    return F.when(_has_scheme(url), F.regexp_extract(_rest(url), "(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _has_scheme(url: Column) -> Column:
    return F.coalesce(F.instr(url, "://") > 0, F.lit(False))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits the host or a parent domain and begins the path; null if none.

    Longest: the longest host, then the longest path.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def alias_targets(html: Column) -> Column:
    """Targets of <link rel=canonical>, <meta property=og:url> and <meta http-equiv=refresh>, as written, in page order."""
    links = F.regexp_extract_all(html, F.lit("(?is)<link\\b[^>]*>"), 0)
    metas = F.regexp_extract_all(html, F.lit("(?is)<meta\\b[^>]*>"), 0)
    href = "(?is)\\bhref\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))"
    content = "(?is)\\bcontent\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))"

    def value(tag: Column, pattern: str) -> Column:
        return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])

    canonical = F.transform(F.filter(links, lambda t: t.rlike("(?is)\\brel\\s*=\\s*[\"']?\\s*canonical\\b")), lambda t: value(t, href))
    shared = F.transform(F.filter(metas, lambda t: t.rlike("(?is)\\bproperty\\s*=\\s*[\"']?\\s*og:url\\b")), lambda t: value(t, content))
    moved = F.transform(
        F.filter(metas, lambda t: t.rlike("(?is)\\bhttp-equiv\\s*=\\s*[\"']?\\s*refresh\\b")),
        lambda t: F.regexp_replace(F.regexp_extract(value(t, content), "(?is)url\\s*=\\s*(.*)$", 1), "^['\"]|['\"]$", ""),
    )
    return F.transform(F.filter(F.concat(canonical, shared, moved), lambda x: F.trim(x) != ""), lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))


def resolve(target: Column, url: Column) -> Column:
    """Absolute form of a link target found on ``url``: absolute, scheme-relative, host-relative or path-relative."""
    scheme = F.substring_index(url, "://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), "(?s)^([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_key(url: Column) -> Column:
    """One key for spellings of the same url: host lower-cased, fragment dropped."""
    return F.concat(F.lower(F.substring_index(url, "://", 1)), F.lit("://"), host_of(url), path_of(url), F.regexp_extract(url, "(?s)^[^?#]*(\\?[^#]*)?", 1))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, alias_group (smallest url of its alias group; null if alone).

    A page with a rule takes the rule's action: an explicit allow is never overruled by aliases. A page without one
    is blocked if any alias, page or link target, falls under a block rule; else allowed. ``redirects`` may add
    (src, dst) urls known from fetching. Null or scheme-less urls have empty host and path, no alias, verdict allow.
    Pages with equal urls are aliases. Null html has no links. Repeated rows are judged alike.
    """
    p = fields(pages, id=id_col, url=url_col, html=html_col)
    p = p.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(_has_scheme(F.col("url")), alias_key(F.col("url"))).alias("key"), "html")
    found = p.filter("key is not null and html is not null").select("key", "url", F.explode(alias_targets(F.col("html"))).alias("target"))
    edges = found.select(F.col("key").alias("a"), alias_key(resolve(F.col("target"), F.col("url"))).alias("b"))
    if redirects is not None:
        r = fields(redirects, s="src", d="dst").filter(_has_scheme(F.col("s")) & _has_scheme(F.col("d")))
        edges = edges.unionByName(r.select(alias_key(F.col("s")).alias("a"), alias_key(F.col("d")).alias("b")))
    edges = cut(edges.filter("a is not null and b is not null and a != b").distinct(), "aliases")
    urls = numbered(edges.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "urls")
    ends = edges.join(urls.select(F.col("key").alias("a"), F.col("uid").alias("src")), "a").join(urls.select(F.col("key").alias("b"), F.col("uid").alias("dst")), "b")
    groups = connected_components(ends.select("src", "dst")).withColumnRenamed("component", "group")
    rule, action = match_rule(host_of(F.col("key")), path_of(F.col("key")), rules)
    members = urls.select("key", F.col("uid").alias("id"), action.alias("action")).join(groups, "id")
    blocked = members.groupBy("group").agg(F.max((F.col("action") == "block").cast("int")).alias("blocked"), F.min("key").alias("alias_group"))
    spread = members.select("key", "group").join(blocked, "group").drop("group")
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    out = p.drop("html").select("id", "host", "path", "key", rule.alias("rule"), action.alias("action"))
    out = out.join(spread, "key", "left")
    verdict = F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("blocked") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "alias_group")
