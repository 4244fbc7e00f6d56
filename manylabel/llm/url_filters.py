"""URL filters with redirect equivalence.

A rule is ``host/path``. It fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's; of several the longest wins. Urls that redirects,
canonical links or a common normal form tie together are aliases: their connected component
is blocked if one of its urls is blocked by a rule. An explicit allow has precedence: a url
that an allow rule fits stays allowed and its neighbours do not change it. What no rule
fits and no alias blocks is allowed.

Rules meet urls by an equi-join on the host's suffixes, so the number of rules is not
bounded by an expression's size. Components are found on distinct urls, hence a url that
a third of all rows have is one node.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule
and is allowed; repeated rows get equal verdicts; an empty table gives an empty table; columns
of the input other than ``url``, ``html`` and the id are ignored by the query and kept by
:func:`judge`, whose own columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, table, unused
from .components import components

#: (rule, action); fixed values of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Query parameters that name a visit, not a page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """Where a site would redirect: https, no ``www.`` or ``m.``, no fragment, tracking, index page or closing slash."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), rf"&{TRACKING}=[^&]*", ""), r"^&", "")
    return F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def absolute(href: Column, url: Column) -> Column:
    """A link's target: absolute, or relative to the page's site; others are null."""
    site = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("/") & (site != ""), F.concat(site, href))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)``: canonical links and meta refreshes of a page, and the redirect to its normal form."""
    u, h = F.col(url), F.coalesce(F.col(html), F.lit(""))
    tag = F.regexp_extract(h, r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    canonical = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(h, r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    targets = F.array(absolute(canonical, u), absolute(refresh, u), normal_form(u))
    return pages.where(u.contains("://")).select(u.alias("src"), F.explode(targets).alias("dst")).where("dst IS NOT NULL AND dst <> src")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, action)`` for the urls that a rule fits. ``urls`` has distinct ``url``, ``host`` and ``path``."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select("rule", "action", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("prefix"))
    fits = urls.where("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix")).join(r, "suffix").where(F.col("path").startswith(F.col("prefix")))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("b"))
    return best.select("url", "b.rule", "b.action")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None, url: str = "url") -> DataFrame:
    """All input columns, ``host``, ``path``, ``rule`` and ``verdict``. ``edges`` (src, dst) default to :func:`alias_edges`."""
    spark = pages.sparkSession
    edges = alias_edges(pages, url) if edges is None else edges
    named = pages.select(F.col(url).alias("url"))
    nodes = named.union(edges.select("src")).union(edges.select("dst")).where("url IS NOT NULL").distinct()
    nodes = nodes.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    matched = match_rules(nodes, spark.createDataFrame(list(rules), "rule string, action string"))
    roots = components(edges)
    placed = matched.where("action = 'block'").join(roots.withColumnRenamed("node", "url"), "url", "left")
    blocked = placed.select(F.coalesce("root", "url").alias("root")).distinct().withColumn("by_alias", F.lit(True))
    aliases = roots.join(blocked, "root").select(F.col("node").alias("url"), "by_alias").union(blocked.select("root", "by_alias"))
    (judged,) = unused(pages.columns, "url")
    verdicts = matched.join(aliases, "url", "full_outer").select(
        F.col("url").alias(judged), "rule", F.coalesce("action", F.when(F.col("by_alias"), F.lit("block")), F.lit("allow")).alias("verdict")
    )
    own = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    d = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return d.join(verdicts, d[url] == verdicts[judged], "left").drop(judged).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    d = judge(pages.select("page_id", "url"), edges=checkpointed(alias_edges(pages)))  # edges have two readers
    return d.select("page_id", "host", "path", "rule", "verdict")


SQL = {
    "op1_url_filters": r"""
WITH RECURSIVE
low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
e0 AS (SELECT url AS src, html, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site,
         regexp_extract(regexp_extract(coalesce(html, ''), '(?i)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS c,
         regexp_extract(coalesce(html, ''), '(?i)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS r,
         regexp_replace(translate(regexp_extract(url, '://([^/?#]*)', 1), u, l), '^(www|m)\.', '') AS nh,
         regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '(index)?\.html?$', ''), '/+$', '') AS np,
         regexp_replace(regexp_replace('&' || regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&', '') AS nq
       FROM pages, low WHERE contains(url, '://')),
e1 AS (SELECT src, unnest([
         CASE WHEN regexp_matches(c, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN c WHEN c LIKE '/%' AND site <> '' THEN site || c END,
         CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN r WHEN r LIKE '/%' AND site <> '' THEN site || r END,
         'https://' || nh || np || CASE WHEN nq <> '' THEN '?' || nq ELSE '' END]) AS dst FROM e0),
e AS (SELECT src AS a, dst AS b FROM e1 WHERE dst <> src UNION SELECT dst, src FROM e1 WHERE dst <> src),
nodes AS (SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), u, l) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path
          FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM e), low),
rules(rule, action, suffix, prefix) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
          ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
matched AS (SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM nodes, rules
            WHERE (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, prefix) GROUP BY url),
reach AS (SELECT url FROM matched WHERE action = 'block' UNION SELECT e.b FROM reach JOIN e ON e.a = reach.url)
SELECT page_id, coalesce(translate(regexp_extract(p.url, '://([^/?#]*)', 1), u, l), '') AS host,
       coalesce(regexp_extract(p.url, '://[^/?#]*([^?#]*)', 1), '') AS path, m.rule,
       coalesce(m.action, CASE WHEN p.url IN (SELECT url FROM reach) THEN 'block' END, 'allow') AS verdict
FROM low, pages p LEFT JOIN matched m ON m.url = p.url"""
}
QUERIES = {"op1_url_filters": op1_url_filters}
