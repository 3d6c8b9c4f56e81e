"""URL filter with redirect equivalence, in DataFrame operations only.

Each url gets the longest rule that fits its host and path. Redirects (meta refresh) and canonical links make urls equivalent:
connected components over those edges are groups of aliases, and a block of one alias blocks the group, unless an alias is
explicitly allowed, which takes precedence for the group. A url's own rule always stands; without rule and without a decided
alias a url is allowed.

Null urls and those without ``://`` have an empty host and path, fit no rule and are allowed. Null or empty html has no links.
Fragments do not tell aliases apart, nor does the case of scheme and host. Repeated rows and repeated urls get the same verdict.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.components import components
from traceloom.llm.joins import small_side
from traceloom.session import cut_lineage

MAX_RULES = 10_000  # a rule list is a parameter of the job and becomes a literal of the plan
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?i)\brel\s*=\s*["']?\s*canonical"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'>\s]+)"""
REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'>\s]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def node_of(url: Column) -> Column:
    """A url as a node: scheme and host in lower case, without fragment; null without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolved(target: Column) -> Column:
    """The absolute url of a link on the page described by the columns scheme, host and path."""
    site = F.concat("scheme", F.lit("://"), "host")
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat("scheme", F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?") | target.startswith("#"), F.concat(site, "path", target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes: each page and the targets of its canonical links and refreshes."""
    url = F.col("url").cast("string")
    tags = pages.where(F.instr(url, "://") > 0).select(url.alias("url"), F.explode(F.regexp_extract_all("html", F.lit(TAG), 0)).alias("tag"))
    target = (
        F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1))
        .when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", REFRESH_URL, 1))
        .otherwise("")
    )
    # few rows; written once, so that the scan of the html is not planned together with what follows
    found = cut_lineage(tags.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target"))).where("target <> ''")
    url = F.col("url")
    parts = found.select(
        "target", node_of(url).alias("a"), F.substring_index(url, "://", 1).alias("scheme"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    absolute = cut_lineage(parts.select("a", resolved(F.col("target")).alias("url")))
    return absolute.select("a", node_of(url).alias("b"))


def alias_verdicts(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(node, group_verdict) of the nodes whose group of aliases has a decision."""
    labels = components(edges)
    url = F.col("node")
    parts = labels.withColumns({"host": host_of(url), "path": path_of(url)})
    decided = parts.withColumn("verdict", longest_rule(F.col("host"), F.col("path"), rules)["verdict"])
    groups = decided.groupBy("label").agg(
        F.when(F.bool_or(F.col("verdict") == "allow"), "allow").when(F.bool_or(F.col("verdict") == "block"), "block").alias("group_verdict")
    )
    return labels.join(groups.where("group_verdict IS NOT NULL"), "label").select("node", "group_verdict")


def judge(pages: DataFrame, rules: list[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``redirects`` may add edges as pairs of urls."""
    edges = page_links(pages)
    if redirects is not None:
        a, b = (F.col(c) for c in redirects.columns[:2])
        edges = edges.unionAll(redirects.select(node_of(a), node_of(b)))
    aliases = small_side(cut_lineage(alias_verdicts(edges, rules)))
    url = F.col("url").cast("string")
    own = pages.select("page_id", url.alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("own_node")
    )
    ruled = own.withColumn("fits", longest_rule(F.col("host"), F.col("path"), rules))
    joined = ruled.join(aliases, F.col("own_node") == F.col("node"), "left")
    verdict = F.coalesce(F.col("fits.verdict"), F.col("group_verdict"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"))


def _sql_rules() -> str:
    return ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _sql_path(url: str) -> str:
    return f"regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1)"


def _sql_node(url: str) -> str:
    rest = f"regexp_extract(substr({url}, instr({url}, '://') + 3), '^[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN instr({url}, '://') > 0 THEN translate(substr({url}, 1, instr({url}, '://') - 1), '{UPPER}', '{LOWER}') || '://' || {_sql_host(url)} || {rest} END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SITE = f"substr(url, 1, instr(url, '://') - 1) || '://' || {_sql_host('url')}"
ORACLE = f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {_sql_rules()}),
tags AS (
    SELECT url, unnest(regexp_extract_all(html, {_quoted(TAG)})) AS tag FROM pages WHERE instr(url, '://') > 0
), targets AS (
    SELECT url, replace(CASE WHEN regexp_matches(tag, {_quoted(CANONICAL)}) THEN regexp_extract(tag, {_quoted(HREF)}, 1)
        WHEN regexp_matches(tag, {_quoted(REFRESH)}) THEN regexp_extract(tag, {_quoted(REFRESH_URL)}, 1) ELSE '' END, '&amp;', '&') AS target
    FROM tags
), absolute AS (
    SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
        WHEN starts_with(target, '//') THEN substr(url, 1, instr(url, '://') - 1) || ':' || target
        WHEN starts_with(target, '/') THEN {_SITE} || target
        WHEN starts_with(target, '?') OR starts_with(target, '#') THEN {_SITE} || {_sql_path('url')} || target
        ELSE {_SITE} || coalesce(nullif(regexp_extract({_sql_path('url')}, '^(.*/)', 1), ''), '/') || target END AS target
    FROM targets WHERE target <> ''
), edges AS (
    SELECT {_sql_node('url')} AS a, {_sql_node('target')} AS b FROM absolute
), both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, label) AS (
    SELECT a, a FROM both_ways UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node
), labels AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
urls AS (
    SELECT DISTINCT url, {_sql_host('url')} AS host, {_sql_path('url')} AS path
    FROM (SELECT url FROM pages UNION SELECT node FROM labels) WHERE url IS NOT NULL
), ruled AS (
    SELECT u.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.url
), groups AS (
    SELECT label, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict
    FROM labels LEFT JOIN ruled ON ruled.url = labels.node GROUP BY label
)
SELECT p.page_id, coalesce({_sql_host('p.url')}, '') AS host, coalesce({_sql_path('p.url')}, '') AS path, r.rule,
    coalesce(r.verdict, g.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN ruled r ON r.url = p.url LEFT JOIN labels l ON l.node = {_sql_node('p.url')} LEFT JOIN groups g ON g.label = l.label
"""
