"""URL filters with redirect equivalence.

1. A rule (host, path) fits its host and all subdomains, for urls whose path starts with the rule's. The longest rule
   wins; of equally long ones the last by host and path; of two for one host and path that which allows. The rules are a
   parameter; each url is looked up under every suffix of its host, so the join is on equality of hosts and grows with
   neither table's square.
2. Urls are nodes, named by host, path and query (an empty path is "/"); a fragment names no other page. All canonical
   links (<link rel="canonical">) and refreshes (<meta http-equiv="refresh">) of a page but those in comments and
   scripts, and rows of a redirect table, are edges. Components are found by distributed star contraction.
3. A url with a rule has that rule's verdict. Another is blocked if an alias in its component is blocked by a rule,
   unless a rule allows some alias: explicit allow takes precedence. Urls with neither are allowed.

Null urls, and urls without ``://``, have the empty host and path, no rule and no alias, and are allowed. Null html
has no edges. Repeated rows each give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .op1_html import host_and_path
from .store import Scope

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules beyond this number are joined and not held in the plan.
MOST_LITERAL = 1000

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Comments and scripts.
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)"
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the rule that wins; null if none fits."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2], r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def _joined_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with found, by a join of distinct urls' host suffixes with the rules' hosts."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    distinct = urls.select("host", "path").distinct().select("host", "path", suffix.alias("rule_host"))
    fits = distinct.join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("verdict", F.concat("rule_host", "rule_path").alias("rule")), F.struct(F.length("rule_host") + F.length("rule_path"), "rule_host", "rule_path", F.col("verdict") == "allow")).alias("found"))
    return urls.join(best, ["host", "path"], "left")


def _node(url: Column) -> Column:
    """Host, and path with query; null without a host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"(\?.*)", 1)
    return F.when(host != "", F.struct(host.alias("host"), F.concat(F.when(path == "", "/").otherwise(path), query).alias("rest")))


def _edges(pages: DataFrame, redirects: DataFrame | None) -> DataFrame:
    """(from, to) of nodes. Relative targets are resolved against the page's scheme and host."""
    html = F.regexp_replace("html", HIDDEN, " ")
    # the cheap test first: few pages have either, and CASE keeps the order
    low = F.lower("html")
    every = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (CANONICAL, REFRESH)))
    some = F.when(low.contains("canonical") | low.contains("http-equiv"), every)
    # each step on what an explode made before, so that no expression holds another one many times over
    links = pages.where(F.col("url").isNotNull()).select("url", F.explode(some).alias("raw"))
    host, path = host_and_path(F.col("url"))
    site = F.struct(F.regexp_extract("url", r"^([^:/?#]*)://", 1).alias("scheme"), host.alias("host"), path.alias("path"), F.regexp_replace("raw", r"(?i)&(?:amp|#38|#x26);", "&").alias("raw"))
    links = links.select("url", F.explode(F.array(site)).alias("x"))
    raw, origin = F.col("x.raw"), F.concat("x.scheme", F.lit("://"), "x.host")
    target = (
        F.when(raw.contains("://"), raw)
        .when(raw.startswith("//"), F.concat("x.scheme", F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(origin, raw))
        .when(raw.startswith("?"), F.concat(origin, "x.path", raw))
        .when(raw != "", F.concat(origin, F.regexp_extract("x.path", r"^(.*/)?", 0), F.when(F.col("x.path") == "", "/").otherwise(""), raw))
    )
    out = links.select("url", F.explode(F.array(target)).alias("target"))
    if redirects is not None:
        out = out.unionByName(redirects.select(F.col("source").alias("url"), "target"))
    named = out.select(_node(F.col("url")).alias("from"), _node(F.col("target")).alias("to"))
    return named.where("from is not null and to is not null and from <> to").distinct()


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict. ``redirects``: (source,
    target) urls. ``rules``: (verdict, host, path), as a sequence or, for many, a table of those columns."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) > MOST_LITERAL:
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")

    def with_rule(urls: DataFrame) -> DataFrame:
        return _joined_rule(urls, rules) if isinstance(rules, DataFrame) else urls.withColumn("found", _rule(F.col("host"), F.col("path"), rules))

    host, path = host_and_path(F.col("url"))
    with Scope(spark) as s:
        edges = s.table(_edges(pages.select("url", "html"), redirects))
        base = with_rule(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), _node(F.col("url"))["rest"].alias("rest")))
        if edges.isEmpty():
            blocked = None
        else:
            nodes = s.table(edges.select(F.col("from").alias("url")).unionByName(edges.select(F.col("to").alias("url"))).distinct().select("url", F.monotonically_increasing_id().alias("node")))
            a, b = (nodes.select(F.col("url").alias(k), F.col("node").alias(n)) for k, n in (("from", "a"), ("to", "b")))
            groups = components(s, edges.join(a, "from").join(b, "to").select("a", "b"))
            members = with_rule(nodes.join(groups, "node").select(F.col("url.host").alias("host"), F.col("url.rest").alias("rest"), F.regexp_extract("url.rest", r"^[^?]*", 0).alias("path"), "component"))
            state = members.groupBy("component").agg(F.max(F.when(F.col("found.verdict") == "block", 1)).alias("block"), F.max(F.when(F.col("found.verdict") == "allow", 1)).alias("allow"))
            hit = state.where("block = 1 and allow is null").select("component")
            blocked = s.keep(members.join(hit, "component").select("host", "rest", F.lit(True).alias("alias_blocked")))
    out = base.join(blocked, ["host", "rest"], "left") if blocked is not None else base.withColumn("alias_blocked", F.lit(False))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("alias_blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _oracle() -> str:
    host = "translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1], r[2]), reverse=True)

    def case(value) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in ordered) + " END"

    return f"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), named AS (
  SELECT page_id, url, html, {host} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(after, '^[^/?#]*[^?#]*([?][^#]*)', 1) AS query FROM cut
), node AS (
  SELECT *, host || CASE path WHEN '' THEN '/' ELSE path END || query AS node FROM named
), linked AS (
  SELECT node, unnest(regexp_extract_all(html, '<link[^>]*rel="canonical"[^>]*href="[^"]*://([^"]*)"', 1)) AS after FROM node WHERE host <> ''
  UNION ALL SELECT node, unnest(regexp_extract_all(html, '<meta[^>]*http-equiv="refresh"[^>]*url=[^":]*://([^"]*)"', 1)) FROM node WHERE host <> ''
), split AS (
  SELECT node, {host} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(after, '^[^/?#]*[^?#]*([?][^#]*)', 1) AS query FROM linked
), targets AS (
  SELECT DISTINCT node AS a, host || CASE path WHEN '' THEN '/' ELSE path END || query AS b FROM split
), both_ways AS (SELECT a, b FROM targets UNION SELECT b, a FROM targets),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
ruled AS (
  SELECT page_id, host, path, node, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS said FROM node
), nodes AS (
  SELECT node, {case(lambda r: r[0])} AS said FROM (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/]*') AS host, regexp_extract(a, '^[^/]*([^?]*)', 1) AS path FROM both_ways)
), aliased AS (
  SELECT r.a AS node, bool_or(n.said = 'block') AND NOT coalesce(bool_or(n.said = 'allow'), false) AS blocked FROM reach r JOIN nodes n ON r.b = n.node GROUP BY r.a
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN aliased USING (node)
"""


ORACLE = _oracle()
