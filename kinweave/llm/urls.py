"""URL filters: rules decide pages, and blocks spread over urls that redirect to or name each other as canonical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base


def split(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; path up to ``?``, ``#`` or the
    end. Null and a url without ``://`` give two empty strings."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    return lowered(host), F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_node(rows: DataFrame, url: str, name: str) -> DataFrame:
    """Adds what a url stands for among aliases: host, path without dot segments, and query; scheme and fragment do not matter. Null
    where there is no host. Built over several projections, so that no step is written out more than once."""
    host, path = split(F.col(url))
    query = F.regexp_extract(F.substring_index(F.col(url), "#", 1), r"(?s)\?.*", 0)
    rows = rows.select("*", host.alias("_host"), path.alias("_path"), query.alias("_query"))
    return rows.withColumn(name, F.when(F.col("_host") != "", F.concat("_host", _dotless(F.col("_path")), "_query"))).drop("_host", "_path", "_query")


def _dotless(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    plain = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda held, x: F.when(x == ".", held).when(x == "..", F.when(F.size(held) > 1, F.slice(held, 1, F.size(held) - 1)).otherwise(held)).otherwise(F.concat(held, F.array(x))))
    joined = F.concat(F.array_join(plain, "/"), F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), joined).otherwise(path)


def resolved(host: Column, path: Column, link: Column) -> Column:
    """The url that a link on a page of that host and path leads to, with any scheme; null for an empty link, a mere fragment, or
    another kind of address (mailto:)."""
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.lit("x:"), link)).when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
        .when(link.startswith("?"), F.concat(F.lit("x://"), host, path, link)).when(link.rlike("^(#|$)"), F.lit(None))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def _attribute(tag: Column, name: str) -> Column:
    forms = '"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)"""
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{form}", 1), F.lit("")) for form in forms))


def links(pages: DataFrame) -> DataFrame:
    """(a, b) for pages (url, html): nodes that a page's canonical link or immediate redirect (meta refresh) joins.

    Tags within comments and scripts do not count. Of each kind all tags count; a page without any has no row.
    """
    shown = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?s)<!--.*?-->", ""), r"(?is)<script\b.*?</script\s*>", "")
    tags = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    kinds = tags.select("url", F.lower(_attribute(tag, "rel")).alias("rel"), F.lower(_attribute(tag, "http-equiv")).alias("equiv"), _attribute(tag, "href").alias("href"), _attribute(tag, "content").alias("content"))
    to = F.regexp_extract("content", r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    # Written once, so that html is searched once: what follows, and its filters, work on the few links.
    named = base.settle(kinds.select("url", F.when(F.array_contains(F.split("rel", r"\s+"), "canonical"), F.col("href")).when(F.col("equiv") == "refresh", to).alias("link")), "links").where("link is not null")
    host, path = split(F.col("url"))
    placed = named.select("url", host.alias("host"), path.alias("path"), F.replace(F.trim("link"), F.lit("&amp;"), F.lit("&")).alias("link"))
    ends = placed.select("url", resolved(F.col("host"), F.col("path"), F.col("link")).alias("to"))
    return with_node(with_node(ends, "url", "a"), "to", "b").select("a", "b").where("a <> b").distinct()


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, ruled of the distinct places (host, path) that a rule (host, path, verdict) fits.

    A rule fits its host and all subdomains where the path begins with the rule's. The longest rule wins; of two as long, allow does.
    Rules meet places by equality: a place's host suffixes find rule hosts, whose lengths of paths say which prefixes to look up, so
    neither many rules of a host nor many urls make a product.
    """
    rules = rules.select(lowered(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("prefix"), "verdict").where("rule_host <> ''").groupBy("rule_host", "prefix").agg(F.min("verdict").alias("verdict"))  # allow comes first
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = places.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    at = asked.join(lengths, "rule_host").select("host", "path", "rule_host", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    fits = at.withColumn("prefix", F.expr("substring(path, 1, n)")).join(rules, ["rule_host", "prefix"])
    rule = F.concat("rule_host", "prefix")
    best = F.max_by(F.struct(rule.alias("rule"), F.col("verdict")), F.struct(F.char_length(rule), F.col("verdict") == "allow", rule))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.col("best.verdict").alias("ruled"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url, html). redirects: from_url, to_url, of a crawl's log.

    A rule decides the urls it fits. Any other url belongs to the component of canonical links and redirects around it: it is blocked
    if a url there, fetched or not, is blocked by a rule and none is allowed by one, so that an explicit allow wins over a block that
    spreads; without either it is allowed. Components are joins in rounds, and a verdict is spread by joins: no group of aliases, even
    one of a third of all pages, meets in one task. Null and repeated page_ids and urls are kept as they are; a null html has no links.
    """
    # html is read for the links alone: what goes on is narrow.
    given = {c: F.col(c).cast(t) if c in pages.columns else F.lit(None).cast(t) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))}
    pages = pages.select(*(x.alias(c) for c, x in given.items()))
    host, path = split(F.col("url"))
    rows = with_node(pages.select("page_id", "url", host.alias("host"), path.alias("path")), "url", "node").drop("url")
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(with_node(with_node(redirects.select("from_url", "to_url"), "from_url", "a"), "to_url", "b").select("a", "b"))
    members = base.components(edges)
    ends = members.select("node", "component", *(x.alias(c) for x, c in zip(split(F.concat(F.lit("x://"), "node")), ("host", "path"), strict=True)))
    known = base.settle(ruled(rows.select("host", "path").unionByName(ends.select("host", "path")), rules), "ruled")
    said = ends.join(known, ["host", "path"]).groupBy("component").agg(F.max(F.col("ruled") == "allow").alias("allowed"), F.max(F.col("ruled") == "block").alias("blocked"))
    spread = members.join(said.where("blocked and not allowed"), "component").select("node", F.lit("block").alias("spread"))
    out = rows.join(known, ["host", "path"], "left").join(spread, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))
