"""URL filters with redirect equivalence, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise
from quillspark.llm.components import connected_components

#: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One tag at a time: rel and http-equiv may stand before or after href and content.
CANONICAL_TAG = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'>\s]+)"""
REFRESH_TAG = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'>\s]+)"""
ABSOLUTE, SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^[A-Za-z][A-Za-z0-9+.-]*:"
TRACKING = r"(^|&)(utm_[^&=]*|ref)(=[^&]*)?"


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty for null or without one."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones an allow goes first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    found = None
    for verdict, rule_host, prefix in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        value = F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def alias_key(rest: Column, host: Column, path: Column) -> Column:
    """The form that a server's usual redirects lead to: no scheme, www., default port, fragment, tracking or final slash."""
    short = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^(&?)(.)", "?$2")
    return F.when(short != "", F.concat(short, F.regexp_replace(path, "/+$", ""), query))


def resolved(target: str, scheme: str, host: str, path: str) -> Column:
    """An absolute url for the target of a link on a page, from column names; null without a target that is a page.

    Only a target that begins with a scheme and "://" is absolute: "/login?next=http://..." is a path. A target with another
    scheme, such as mailto:, or a fragment alone leads nowhere. Ampersands may be written as entities.
    """
    t = F.regexp_replace(F.col(target), "&(amp|#38|#x26);", "&")
    origin = F.concat(F.col(scheme), F.lit("://"), F.col(host))
    return (
        F.when((t == "") | t.startswith("#"), None)
        .when(t.rlike(ABSOLUTE), t)
        .when(t.rlike(SCHEME), None)
        .when(t.startswith("//"), F.concat(F.col(scheme), F.lit(":"), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?"), F.concat(origin, F.col(path), t))
        .otherwise(F.concat(origin, F.regexp_replace(F.col(path), "[^/]*$", ""), t))
    )


def filter_urls(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, host, path, rule, verdict), a row per input row.

    A graph has urls and normal forms as nodes and three kinds of edges: a server's usual redirects (scheme, www., fragment,
    tracking parameters, final slash) lead from a url to its normal form; canonical links and refresh redirects lead from
    a page to the form of their target. Pages in one connected component are aliases, over any number of
    steps. A page with a rule keeps that rule's verdict. Other pages take their aliases': allow if any
    alias is explicitly allowed, else block if any is blocked, else allow.

    The graph has a node for each distinct url, never a page per copy, and leaves out urls that are alone with their form and have
    no link: they have no alias. Verdicts are joined back by url as two flags. Null or malformed url: empty host and path, no
    rule, no alias, allow. Null html: no links. Repeated rows get equal verdicts. An empty table gives no rows.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    # Each step's columns are used several times in the next one, so that none is computed twice.
    judged = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), after_scheme(F.col(url_col)).alias("rest"),
        F.regexp_extract(F.col(url_col), "^(.*?)://", 1).alias("scheme"),
        F.regexp_extract(F.regexp_extract(html, CANONICAL_TAG, 0), HREF, 1).alias("to1"),
        F.regexp_extract(F.regexp_extract(html, REFRESH_TAG, 0), REFRESH_URL, 1).alias("to2"),
    )
    judged = judged.withColumns({"host": host_of(F.col("rest")), "path": path_of(F.col("rest"))})
    judged = judged.withColumns({f"url{i}": resolved(f"to{i}", "scheme", "host", "path") for i in (1, 2)})
    judged = judged.withColumns({f"rest{i}": after_scheme(F.col(f"url{i}")) for i in (1, 2)})
    judged = judged.withColumns({f"host{i}": host_of(F.col(f"rest{i}")) for i in (1, 2)})
    link = lambda i: alias_key(F.col(f"rest{i}"), F.col(f"host{i}"), path_of(F.col(f"rest{i}")))
    judged = judged.select(
        "id", "host", "path", "url", alias_key(F.col("rest"), F.col("host"), F.col("path")).alias("form"),
        link(1).alias("canonical"), link(2).alias("refresh"),
        matched_rule(F.col("host"), F.col("path"), rules).alias("own"),
    )
    judged = materialise(judged, "urls")
    linked = materialise(connected_components(alias_edges(judged)), "aliases")
    explicit = (
        judged.where("form IS NOT NULL AND own IS NOT NULL")
        .groupBy("url")
        .agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
        .join(linked.withColumnRenamed("node", "url"), "url")
        .groupBy("component")
        .agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    )
    blocked = linked.join(explicit.where("blocked AND NOT allowed"), "component").select(F.col("node").alias("blocked_url"))
    blocked = materialise(blocked, "blocked")
    return judged.join(blocked, (F.col("url") == F.col("blocked_url")) & F.col("own").isNull(), "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("blocked_url").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
    )


def alias_edges(judged: DataFrame) -> DataFrame:
    """(src, dst) from pages (url, form, canonical, refresh): from forms to the forms of their links, and from urls to their forms.

    Urls have "://" and forms don't begin with a scheme, so the two kinds of nodes are marked apart by their first character.
    """
    targets = F.array_distinct(F.array("canonical", "refresh"))
    links = judged.select("form", F.explode(targets).alias("to")).where("form <> to").distinct()
    forms = judged.where("form IS NOT NULL").select("url", "form").distinct()
    # A url alone with its form can only have an alias if a link starts or ends at the form.
    met = forms.select("form").unionAll(links.select("form")).unionAll(links.select("to"))
    met = materialise(met.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "met")
    node = lambda c: F.concat(F.lit("="), c)
    redirects = forms.join(met, "form").select(F.col("url").alias("src"), node("form").alias("dst"))
    return redirects.unionAll(links.select(node("form").alias("src"), node("to").alias("dst")))


#: DuckDB SQL for op3's rows.
SQL = r"""
WITH RECURSIVE a AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), t AS (
  SELECT *, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''>\s]+)', 1) AS canonical,
    regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''>\s]+)', 1) AS refresh FROM a
), hp AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM t
), h AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^(.*?)://', 1) AS scheme FROM hp
), links AS (
  SELECT rid, 0 AS kind, url AS target FROM h
  UNION ALL
  SELECT rid, kind, CASE WHEN x = '' OR starts_with(x, '#') THEN NULL WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x
    WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(x, '//') THEN scheme || ':' || x
    WHEN starts_with(x, '/') THEN scheme || '://' || host || x WHEN starts_with(x, '?') THEN scheme || '://' || host || path || x ELSE scheme || '://' || host || regexp_replace(path, '[^/]*$', '') || x END
  FROM (SELECT * REPLACE (regexp_replace(x, '&(amp|#38|#x26);', '&', 'g') AS x)
    FROM (SELECT *, 1 AS kind, canonical AS x FROM h UNION ALL SELECT *, 2, refresh FROM h))
), lr AS (
  SELECT rid, kind, CASE WHEN instr(target, '://') > 0 THEN substr(target, instr(target, '://') + 3) ELSE '' END AS rest FROM links WHERE target IS NOT NULL
), lk AS (
  SELECT rid, kind, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '') AS h,
    regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^&=]*|ref)(=[^&]*)?', '', 'g'), '^&', '') AS q FROM lr
), keys AS (
  SELECT rid, kind, CASE WHEN h <> '' THEN h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS k FROM lk
), edges AS (
  SELECT DISTINCT o.k AS src, l.k AS dst FROM keys o JOIN keys l USING (rid) WHERE o.kind = 0 AND l.kind > 0 AND o.k <> l.k
), both_ways AS (
  SELECT src, dst FROM edges UNION SELECT dst, src FROM edges
), reach(k, to_k) AS (
  SELECT DISTINCT src, src FROM both_ways UNION SELECT r.k, b.dst FROM reach r JOIN both_ways b ON b.src = r.to_k
), comp AS (
  SELECT k, min(to_k) AS c FROM reach GROUP BY k
), judged AS (
  SELECT h.rid, page_id, host, path, keys.k,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM h LEFT JOIN keys ON keys.rid = h.rid AND keys.kind = 0
), ruled AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own,
    coalesce(c, judged.k) AS component FROM judged LEFT JOIN comp ON comp.k = judged.k
), flags AS (
  SELECT component, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM ruled
  WHERE own IS NOT NULL AND component IS NOT NULL GROUP BY component
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN flags USING (component)
"""
