"""URL filter with redirect equivalence.

Rules name a host with all its subdomains and the start of a path; the longest rule that fits decides. Urls
that redirect to each other or name each other canonical are aliases: their connected components are found
with joins, and a block spreads to the aliases that no rule names, unless an alias is explicitly allowed.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, fixed
from quire.llm.components import connected_components
from quire.llm.markup import attributes, tags_of

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

_REFRESH_URL = re.compile(r"""^[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)
_CONTROLS = re.compile(r"[\t\n\r]")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def same_page(url: Column) -> Column:
    """The url without its fragment, scheme and host in lower case; null without a host."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), rest))


def _absolute(base: str, link: str) -> str | None:
    """``link`` as found on a page at ``base``; None if it is empty, unreadable or only a fragment."""
    link = _CONTROLS.sub("", link).strip()
    if not link or link.startswith("#"):
        return None
    try:
        return urljoin(base, link)
    except ValueError:  # such as an unclosed bracket in the host
        return None


def links_of(url: str, source: str) -> list[str]:
    """Absolute addresses that a page names as canonical or refreshes to, in page order.

    ``rel`` is a list of words; the first ``base`` counts for all links of the page; comments, scripts and the like hold no
    links. All tags count, not only the first.
    """
    links, base = [], url
    based = False
    for _, tag, end, rest in tags_of(source):
        if end or tag not in ("link", "meta", "base"):
            continue
        named = attributes(rest)
        if tag == "base" and "href" in named and not based:
            based, base = True, _absolute(url, named["href"]) or url
        elif tag == "link" and "canonical" in named.get("rel", "").lower().split():
            links.append(named.get("href", ""))
        elif tag == "meta" and named.get("http-equiv", "").strip().lower() == "refresh":
            found = _REFRESH_URL.match(named.get("content", ""))
            links.append("".join(g or "" for g in found.groups()) if found else "")
    return [target for target in (_absolute(base, link) for link in links) if target is not None]


def _page_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, targets = [], []
        for url, page in zip(batch.column(0), batch.column(1), strict=True):  # one page at a time in memory
            found = dict.fromkeys(links_of(url.as_py(), page.as_py()))
            sources += [url.as_py()] * len(found)
            targets += found
        yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(targets, pa.string())], names=["url", "target"])


def alias_edges(pages: DataFrame) -> DataFrame:
    """src, dst: what pages (url, html) name as their canonical address or refresh to.

    Only pages that hold one of the two words, in any case, are read tag by tag.
    """
    bounded_batches(pages.sparkSession)
    holds = F.col("html").rlike("(?i)canonical|refresh") & (host_of(F.col("url")) != "")
    links = pages.where(holds).select("url", "html").mapInArrow(_page_links, "url string, target string")
    links = fixed(links, "links")
    return links.select(same_page(F.col("url")).alias("src"), same_page(F.col("target")).alias("dst"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """action, rule, rule_host, rule_path from pairs such as ("block", "example.com/de/")."""
    rows = [(action, rule, rule.partition("/")[0].lower(), "/" + rule.partition("/")[2]) for action, rule in rules]
    return spark.createDataFrame(rows, "action string, rule string, rule_host string, rule_path string")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """node, action, rule: the longest fitting rule of each distinct ``node``; allow wins between equals.

    Joined on the host and its parent domains, so that a long list of rules costs one equi-join.
    """
    labels = F.split(host_of(F.col("node")), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    spread = urls.select("node", path_of(F.col("node")).alias("path"), F.explode(parents).alias("rule_host"))
    fits = spread.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action"))
    return fits.groupBy("node").agg(best.alias("best")).select("node", "best.action", "best.rule")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    ``redirects``: more edges (src, dst urls). The verdict is that of the longest fitting rule. A url without
    one is allowed if any alias is explicitly allowed, else blocked if any alias is blocked, else allowed.
    A null url, or one without "://", has an empty host and path, no rule and no aliases, and is allowed.
    Null html has no links; all links of a page count, however long it or its url is. Repeated rows are judged alike;
    other columns are not looked at. An empty table gives an empty one.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(same_page(F.col("src")).alias("src"), same_page(F.col("dst")).alias("dst")))
    groups = connected_components(edges)
    url = F.col("url")
    rows = pages.select("page_id", same_page(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"))
    nodes = rows.select("node").where("node is not null").unionByName(groups.select("node")).distinct()
    judged = fixed(fitting_rules(nodes, rules), "judged-urls")
    named = groups.join(judged, "node").groupBy("component").agg(
        F.max((F.col("action") == "allow").cast("int")).alias("any_allow"), F.max((F.col("action") == "block").cast("int")).alias("any_block")
    )
    spread = groups.join(named, "component").select("node", "any_allow", "any_block")
    judged = judged.join(spread, "node", "full_outer")
    verdict = (
        F.when(F.col("action").isNotNull(), F.col("action"))
        .when(F.col("any_allow") == 1, "allow")
        .when(F.col("any_block") == 1, "block")
        .otherwise("allow")
    )
    return rows.join(judged, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
