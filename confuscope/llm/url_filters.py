"""URL filters: block and allow rules by host and path, carried over redirects and canonical links.

Only DataFrame functions are used. Rules are a table of any size: a url meets those of its host's suffixes whose paths are
starts of its own, by two equi-joins. A url's own rule always decides. A url without a rule is blocked
if a url that redirects or canonical links make equivalent to it is blocked by a rule; explicit allow
rules take precedence in two ways: a url that an allow rule fits is never blocked through its
aliases, and of two rules of equal length the allow rule wins. Everything else is allowed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host followed by the start of a path, like ``example.net/en/``."""

    action: str
    pattern: str

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block"):
            raise ValueError(f"unknown action {self.action!r}")
        if "/" not in self.pattern or self.pattern.startswith("/"):
            raise ValueError(f"a rule is a host and a path, not {self.pattern!r}")


def url_host(url: Column) -> Column:
    """Lower-case host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path: after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """Identity of a url in the alias graph: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), url_path(url), query))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, not wherever the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """(rule_host, rule_path, action, pattern), one row for each host and path; allow precedes."""
    if not isinstance(rules, DataFrame):
        # One literal, which the JVM takes apart.
        rows = json.dumps([{"action": r.action, "pattern": r.pattern} for r in rules])
        rules = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<action:string,pattern:string>>")))
    at = F.instr("pattern", "/")
    parts = rules.select(ascii_lower(F.substring("pattern", F.lit(1), at - 1)).alias("rule_host"), F.substring("pattern", at, F.length("pattern")).alias("rule_path"), "action", "pattern")
    best = parts.groupBy("rule_host", "rule_path").agg(F.min(F.struct("action", "pattern")).alias("best"))
    return best.select("rule_host", "rule_path", "best.action", "best.pattern")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with columns host and path) with the pattern and action of the longest rule that fits, null if none does.

    Distinct urls are looked up, so a url that very many rows have costs one. A host meets the rules of its
    suffixes with as many labels as rules have; their distinct path lengths, not the rules, are what is tried.
    """
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first()["n"] or 0
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    distinct = urls.select("host", "path").where("host <> ''").distinct()
    hosts = distinct.select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    tried = hosts.select("host", "path", "rule_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    fits = tried.withColumn("rule_path", F.substring("path", F.lit(1), F.col("n"))).join(rules, ["rule_host", "rule_path"])
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("pattern")).alias("n"), "action", "pattern")).alias("best"))
    return urls.join(best, ["host", "path"], "left").withColumn("rule", F.col("best.pattern")).withColumn("own", F.col("best.action")).drop("best")


def _absolute(base: Column, link: Column) -> Column:
    """``link`` as it reads on the page ``base``; null for other schemes than http and https."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = _let(F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1), lambda x: F.when(x.endswith("/"), x).otherwise(F.concat(x, F.lit("/"))))
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when((link == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, link))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) keys of pages and the targets of their canonical links and meta refreshes.

    Pages without a usable url or html give no edge; a page may give several.
    """
    url, html = F.col(url_col), F.col(html_col)
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    value = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    attr = lambda tag, name: F.concat(*[F.regexp_extract(tag, rf"(?is)\s{name}{value}", k) for k in (1, 2, 3)])
    refresh = lambda tag: F.regexp_extract(attr(tag, "content"), r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*['\"]?([^'\"\s]+)", 1)
    link = lambda tag: (
        F.when(F.lower(attr(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)"), attr(tag, "href")).when(F.lower(attr(tag, "http-equiv")) == "refresh", refresh(tag))
    )
    found = (
        pages.select(url.alias("url"), html.alias("html"))
        .where((F.instr("url", "://") > 0) & F.col("html").rlike("(?i)canonical|refresh"))
        .select("url", F.explode(tags).alias("tag"))
        .select("url", _let(F.col("tag"), lambda tag: F.trim(link(tag))).alias("link"))
    )
    target = _let(F.col("link"), lambda link: _let(F.col("url"), lambda base: _let(_absolute(base, link), url_key)))
    return found.select(_let(F.col("url"), url_key).alias("a"), target.alias("b")).where("a <> b")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """Judge every row of ``pages``: (page_id, host, path, rule, verdict, decided_by).

    ``rules``: or a table (action, pattern) of any size. ``edges``: more redirects, as full urls in columns (src, dst). Aliases are the connected
    components of these and the pages' own canonical and refresh links. decided_by is rule, alias
    or default. Null or malformed urls have empty host and path and are allowed by default; repeated
    rows are judged alike, each giving a row; other columns of ``pages`` are left out, whatever their
    names; an empty table gives an empty result.
    """
    links = [alias_edges(pages, url_col, html_col)] if html_col else []
    if edges is not None:
        links.append(edges.select(_let(F.col("src"), url_key).alias("a"), _let(F.col("dst"), url_key).alias("b")).where("a <> b"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    table = written(rule_table(pages.sparkSession, rules), "rules")
    judged = with_rules(base.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), table)
    plain = judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"),
                          F.when(F.col("own").isNotNull(), "rule").otherwise("default").alias("decided_by"))
    if not links:
        return plain
    graph = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    graph = written(graph.distinct(), "aliases")
    if graph.isEmpty():
        return plain
    nodes = connected_components(graph)
    as_url = F.concat(F.lit("http://"), F.col("node"))
    ruled = with_rules(nodes.select("component", url_host(as_url).alias("host"), url_path(as_url).alias("path")), table)
    blocked = ruled.where("own = 'block'").select("component").distinct()
    # One row for each key, so the join adds no rows; pages that share one key are split by adaptive execution.
    aliases = written(nodes.join(blocked, "component").select("node").distinct(), "blocked")
    if aliases.isEmpty():
        return plain
    open_rows = judged.where("own is null").withColumn("node", url_key(F.col("url")))
    keyed = open_rows.where("node is not null").join(aliases.withColumn("hit", F.lit(True)), "node", "left")
    by_alias = keyed.select("page_id", "host", "path", "rule", F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"),
                            F.when(F.col("hit"), "alias").otherwise("default").alias("decided_by"))
    rest = plain.where((F.col("decided_by") == "rule"))
    bare = open_rows.where("node is null").select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit("default").alias("decided_by"))
    return rest.unionByName(by_alias).unionByName(bare)
