"""URL filters with redirect equivalence, by DataFrame operations only.

A rule is (host, path, action): it fits its host and all subdomains where the URL's path starts with the rule's; of those
that fit, the longest wins. Pages whose URLs are joined by redirects (meta refresh, or given pairs) or canonical links form a
class, with link targets that are no pages of the table. A page that no rule fits takes the class's decision: blocked if a rule
blocks one of the class, unless a rule explicitly allows one of the class; explicit decisions of a page itself always stand. All
else is allowed. Relative targets are resolved against the page's folder.

Null URLs, and URLs without ``://``, have an empty host and path, fit no rule and belong to no class; null html has no links.
Repeated rows get the same verdict each; an empty table gives an empty result; further columns are ignored. Two URLs are one
node if host, path and query agree (scheme and fragment aside).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import load, materialise
from tessera.llm.components import connected_components

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Up to so many rules are tested as a literal; more are joined by host.
INLINE_RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A 64-bit name of the resource; null where the URL has no host."""
    path, query = path_of(url), F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.xxhash64(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def _inline(pages: DataFrame, rules: list[tuple[str, str, str]]) -> Column:
    """The best rule that fits, as a struct of size, rule and action."""
    fits = [
        F.when(((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")))
        for h, p, a in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else (fits[0] if fits else F.lit(None).cast("struct<size:int,rule:string,action:string>"))


def match_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and action (null where none fits) to rows with host and path."""
    if len(rules) <= INLINE_RULES:
        best = _inline(pages, rules)
        return pages.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("action", F.col("best.action")).drop("best")
    table = pages.sparkSession.createDataFrame([(h, p, a, len(h + p)) for h, p, a in rules], "rule_host string, rule_path string, action string, size int")
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = urls.select("host", "path", F.explode(tails).alias("rule_host")).join(table, "rule_host").where(F.startswith("path", "rule_path"))
    best = fit.groupBy("host", "path").agg(F.max(F.struct("size", F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("best"))
    return pages.join(best, ["host", "path"], "left").withColumn("rule", F.col("best.rule")).withColumn("action", F.col("best.action")).drop("best")


def _folded(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    held = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda held, part: F.when(part == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))).when(part == ".", held).otherwise(F.concat(held, F.array(part))),
    )
    return F.concat(F.array_join(held, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))


def _target(href: Column, url: Column) -> Column:
    """An absolute URL for a link's target; null for other kinds of URL (mailto:, data:) and where a relative one has no host."""
    href = F.trim(href)
    path, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    site = F.concat(F.lit("http://"), host_of(url))
    known = host_of(url) != ""
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), href)
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href))
        .when(known & F.startswith(href, F.lit("#")), url)
        .when(known & F.startswith(href, F.lit("?")), F.concat(site, own, href))
        .when(known & F.startswith(href, F.lit("/")), F.concat(site, _folded(path), tail))
        .when(known, F.concat(site, _folded(F.concat(F.regexp_extract(own, r"^(.*/)", 1), path)), tail))
    )


def _ends(found: DataFrame, from_url: Column, to_url: Column) -> DataFrame:
    """u, v and the host and path of both."""
    ends = found.select(*(x.alias(n) for c, url in (("u", from_url), ("v", to_url)) for n, x in ((c, node_of(url)), (f"{c}_host", host_of(url)), (f"{c}_path", path_of(url)))))
    return ends.where("u is not null and v is not null and u != v")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """u, v: the nodes of each page and of every canonical or refresh target that it names, with the host and path of both."""
    page, body = F.col(url), F.col(html)
    canonical = F.regexp_extract_all(body, F.lit(r"(?is)<link\s(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    refresh = F.regexp_extract_all(body, F.lit(r"(?is)<meta\s(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    found = pages.where(body.isNotNull() & page.isNotNull()).select(page.alias("url"), F.explode(F.concat(canonical, refresh)).alias("href")).where(F.col("href") != "").withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&")))
    return _ends(found, F.col("url"), _target(F.col("href"), F.col("url")))


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """key, host, path, rule, verdict and component (null outside any class). redirects: further pairs (from_url, to_url)."""
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(_ends(redirects, F.col("from_url"), F.col("to_url")))
    edges = materialise(edges.distinct(), "url-edges")
    own = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node"))
    own = match_rules(own, rules)
    if edges.isEmpty():
        return own.select(key, "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("component"))
    classes = materialise(connected_components(edges.select("u", "v").distinct(), "u", "v"), "url-classes")
    placed = own.join(classes, own["node"] == classes["node"], "left").drop(classes["node"])
    # A target that is no page of the table decides like a page.
    ends = edges.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.col(f"{c}_host").alias("host"), F.col(f"{c}_path").alias("path")) for c in "uv"))).alias("end")).select("end.*")
    linked = match_rules(ends.distinct(), rules).where("action is not null").join(classes, "node").select("component", "action")
    ruled = placed.where("component is not null and action is not null").select("component", "action").union(linked)
    decided = ruled.groupBy("component").agg(F.max((F.col("action") == "block").cast("int")).alias("b"), F.max((F.col("action") == "allow").cast("int")).alias("a"))
    joined = placed.join(decided, "component", "left")
    passed = F.when((F.col("b") == 1) & (F.coalesce("a", F.lit(0)) == 0), "block").otherwise("allow")
    return joined.select(key, "host", "path", "rule", F.coalesce("action", passed).alias("verdict"), "component")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"))


#: For tables whose pages hold neither canonical links nor refreshes, where rules alone decide.
SQL = r"""
with p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r as (
  select page_id, host, path, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from q)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict,
  cast(null as bigint) as component from r
"""
