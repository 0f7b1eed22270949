"""URL filters by redirect equivalence.

A rule (host, path, verdict) fits the urls of its host and of all its subdomains whose path
starts with the rule's; the longest fitting rule decides, of equally long ones the allowing.
Urls that no rule fits take part in redirect equivalence: pages tell their canonical url
(``<link rel=canonical>``) and their redirects (``<meta http-equiv=refresh>``), crawl logs may
add more, and the connected components over these links hold the aliases of one document. A
url in a component with a blocked url is blocked too. An explicit rule has precedence over what
is inherited: an allowed url stays allowed whatever its aliases are.

Urls meet as strings without fragment, with scheme and host in lower case. Only urls with a
link get a number and go through the components; the numbers stand for whole urls, so no two
urls are taken for one. Link rows and pages are joined on (url, its length): both sides come
from plain exchanges, so a target that a third of all pages name can be split.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule
and are nobody's alias, so they are allowed; null html has no links; links inside comments,
scripts, styles and the like, links to other schemes' opaque names and links that cannot be
resolved don't count; targets need not be pages; html is read whole, in one pass, at any
length; repeated rows get equal results; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import ascii_lower, batch_limits, materialize, store, text_of
from ledgerflow.llm.components import connected_components


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str            # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


#: Elements whose content is text or is not shown.
RAW = "script style title textarea xmp iframe noembed noframes noscript template".split()
MARK = re.compile(rf"<(?:(!--)|({'|'.join(RAW)})(?=[\s/>])|(link|meta|base)(?=[\s/>]))", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""[\s/"']*([^\s/>="']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
REFRESH = re.compile(r"""\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from there on, and where they end."""
    out: dict[str, str] = {}
    while (m := ATTRIBUTE.match(page, at)) and m.end() > at:
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()
    return out, at


def linked_urls(page: str, url: str) -> list[str]:
    """The canonical urls and redirect targets that a page names, resolved against its url."""
    found, base, at = [], None, 0
    while (m := MARK.search(page, at)):
        at = m.end()
        if m[1]:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
        elif m[2]:
            end = ENDS[m[2].lower()].search(page, at)
            at = end.end() if end else len(page)
        else:
            own, at = _attributes(page, at)
            name, to = m[3].lower(), None
            if name == "base" and base is None:
                base = own.get("href")
            elif name == "link" and "canonical" in own.get("rel", "").lower().split():
                to = own.get("href")
            elif name == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
                refresh = REFRESH.match(own.get("content", ""))
                to = refresh and (refresh[1] or refresh[2] or refresh[3])
            if to and to.strip():
                found.append(to.strip())
    out = []
    for to in found:
        try:
            out.append(urljoin(urljoin(url, base.strip()) if base else url, to))
        except ValueError:                                  # no url, such as one with half an IPv6 host
            continue
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What the rules read: the host with A-Z in lower case, and the path."""
    def part(n: int) -> Column:
        return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))

    return ascii_lower(part(1)), part(2)


def url_key(url: Column) -> Column:
    """The url as a node: without fragment, scheme and host in lower case; null without ``://``."""
    def part(n: int) -> Column:
        return F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^#]*)", n)

    return F.when(F.contains(url, F.lit("://")), F.concat(ascii_lower(part(1)), part(2)))


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the rule that decides, null if none fits."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): the links between different urls that the pages name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(u, to) for u, page in zip(pdf["url"], pdf["html"]) for to in linked_urls(page, u)],
                               columns=["a", "b"])

    batch_limits(pages.sparkSession)
    some = pages.select("url", text_of("html").alias("html")).filter(
        F.contains("url", F.lit("://")) & F.col("html").rlike("(?i)canonical|refresh"))
    return some.mapInPandas(run, "a string, b string").select(url_key(F.col("a")).alias("a"), url_key(F.col("b")).alias("b"))


def blocked_aliases(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key): every url with a link whose component holds a blocked url."""
    links = materialize(links.filter("a <> b").distinct())
    nodes = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    nodes = store(nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("length", F.length("key")), "url-nodes")
    ends = links.withColumn("length", F.length("a")).join(
        nodes.select(F.col("key").alias("a"), "length", F.col("id").alias("i")), ["a", "length"])
    ends = ends.select("i", "b", F.length("b").alias("length")).join(
        nodes.select(F.col("key").alias("b"), "length", F.col("id").alias("j")), ["b", "length"])
    roots = connected_components(ends.select(F.col("i").alias("a"), F.col("j").alias("b")))
    labelled = nodes.join(roots, nodes["id"] == roots["node"], "left").select("key", F.coalesce("root", "id").alias("root"))
    labelled = store(labelled, "url-components")
    blocked = labelled.filter(fitting_rule(rules, *host_and_path(F.col("key")))["verdict"] == "block").select("root").distinct()
    # the second key lets adaptive execution split a component that holds most urls
    blocked = materialize(blocked).withColumn("low", F.col("root") % 1024)
    return labelled.withColumn("low", F.col("root") % 1024).join(blocked, ["root", "low"]).select("key")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict, inherited (blocked as an alias).
    ``links`` (a, b: urls) adds redirects known otherwise, such as those of a crawl log."""
    known = page_links(pages)
    if links is not None:
        known = known.union(links.select(url_key(F.col("a")), url_key(F.col("b"))))
    aliases = materialize(blocked_aliases(known, rules)).withColumnRenamed("key", "alias")
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"), url_key(F.col("url")).alias("key"))
    own = own.withColumn("own", fitting_rule(rules, F.col("host"), F.col("path")))
    out = own.join(aliases, (F.col("key") == F.col("alias")) & (F.length("key") == F.length("alias")), "left")
    inherited = F.col("own").isNull() & F.col("alias").isNotNull()
    return out.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"),
                      F.coalesce("own.verdict", F.when(inherited, "block").otherwise("allow")).alias("verdict"),
                      inherited.alias("inherited"))
