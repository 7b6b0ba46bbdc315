"""Allow and block decisions on URLs, carried over to aliases.

Rules name a host and a path start; a rule fits its host and all subdomains where the path
begins with the rule's, and the longest wins.  URLs that no rule fits get the decision of their
aliases: URLs are joined by edges (redirects, canonical links, spellings of one address), and
the connected components of these are the aliases of a page.  A page whose aliases hold a
blocked URL is blocked, unless they hold an allowed one too: an explicit allow precedes.  All
else is allowed.

Everything is DataFrame work: text functions, then components by joins and aggregates (see
``common.connected_components``); the decisions of a component are one aggregate, which combines
before the shuffle, so a host with a third of all pages is no hot key.

Null, empty and repeated: a URL that is null or has no ``://`` has an empty host and path, fits
no rule, has no edge and is allowed; repeated rows each get their row; an empty table gives no
row; a null document has no edges; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.llm.common import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Spellings of one address: what a site's own redirects take away.
HOST_PREFIX = r"^(?:www|m)\."
PAGE_SUFFIX = r"(?:/+|/index\.html?|\.html?)$"
TRACKING = r"^(?:utm_[a-z]+|ref)$"

LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host, path = F.col("host"), F.col("path")
    on_host = (host == rule.host) | host.endswith("." + rule.host)
    return on_host & path.startswith(rule.path)


def with_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The pages with host, path, rule (null where none fits) and ruled (allow, block or null)."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def first(value) -> Column:
        return F.coalesce(*[F.when(_fits(r), F.lit(value(r))) for r in ordered],
                          F.lit(None).cast("string"))

    located = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return located.withColumns({"rule": first(lambda r: r.name), "ruled": first(lambda r: r.verdict)})


def address(url: Column) -> Column:
    """The one address behind a URL's spellings; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.split(p, "=")[0].rlike(TRACKING)))
    host = F.regexp_replace(host_of(url), HOST_PREFIX, "")
    path = F.regexp_replace(path_of(url), PAGE_SUFFIX, "")
    text = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                    .otherwise(F.lit("")))
    return F.when(host != "", text)


def _absolute(base: Column, target: Column) -> Column:
    """A link's target as a URL; targets relative to a folder are taken from the host's root."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return (F.when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host_of(base), target))
            .when(target != "", F.concat(scheme, F.lit("://"), host_of(base), F.lit("/"), target)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v) between URLs and their addresses, and between a page's and those it points to.

    Redirect edges: a URL to its plain address, and a refresh tag's target.  Canonical edges:
    the target of a canonical link tag.  Each spelling hangs on its address, so there is one
    edge per URL and no pair of aliases is ever formed.
    """
    url = F.col("url")
    known = pages.where(host_of(url) != "")
    spelled = known.select(F.concat(F.lit("url "), url).alias("u"),
                           F.concat(F.lit("at "), address(url)).alias("v"))
    tagged = known.where(F.col("html").isNotNull()).select(
        url,
        F.regexp_extract(F.regexp_extract("html", LINK_TAG, 0), HREF, 1).alias("canonical"),
        F.regexp_extract(F.regexp_extract("html", REFRESH_TAG, 0), REFRESH_URL, 1).alias("refresh"))
    pointed = tagged.select(url, F.explode(F.array("canonical", "refresh")).alias("target")).select(
        url, _absolute(url, F.col("target")).alias("target"))
    target = F.col("target")
    return spelled.union(pointed.select(
        F.concat(F.lit("at "), address(url)), F.concat(F.lit("at "), address(target)))
    ).union(pointed.select(
        F.concat(F.lit("url "), target), F.concat(F.lit("at "), address(target)))
    ).where("u is not null and v is not null").distinct()


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The pages with host, path, rule and verdict."""
    ruled = with_rules(pages, rules)
    roots = connected_components(alias_edges(pages), "aliases")
    urls = roots.where(F.col("node").startswith("url "))
    decided = with_rules(urls.select("root", F.substr("node", F.lit(5)).alias("url")), rules).where(
        "ruled is not null").groupBy("root").agg(
        F.bool_or(F.col("ruled") == "allow").alias("allowed"),
        F.bool_or(F.col("ruled") == "block").alias("blocked"))
    carried = urls.join(decided, "root").where("blocked and not allowed").select("node")
    blocked = carried.withColumn("_carried", F.lit("block"))
    joined = ruled.withColumn("node", F.concat(F.lit("url "), F.col("url"))).join(
        blocked, "node", "left")
    return joined.withColumn(
        "verdict", F.coalesce("ruled", "_carried", F.lit("allow"))).drop("node", "_carried", "ruled")
