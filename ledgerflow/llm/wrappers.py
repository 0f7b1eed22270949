"""HTML extraction by union-free wrappers, inferred per host.

A page is read as a stream of text blocks, each under the path of its open elements. Wrappers
are union-free regular expressions over such paths: a sequence of items, each a group of paths
that may repeat, be optional and carry constant text or a text slot. ``page_wrapper`` turns one
page into a wrapper, folding runs of equal groups into repeats; ``align`` joins two wrappers of
a host: a text mismatch becomes a slot, different counts of a group a repeat, and what only one
side has an optional item. Each task joins the wrappers of the pages it reads, the partial
wrappers of a host are joined in salted groups and then in one, so a host with a third of all
pages sends one small wrapper per task.

``content_paths`` chooses the article among a page's own paths, by their sizes in the host's
wrapper: all under article or main elements, otherwise the deepest container with most of the
running text; menus, headers, footers, sidebars, notices, adverts, forms and comments are told
by element, class or id, outside an article by their share of links or by text that is constant
over the host, and inside only by both. Pages then keep the blocks on the chosen paths.

Alignment takes memory linear in the pages, and a wrapper with very many items keeps one of
each group, so large or unlike pages cost their length; so do malformed ones: unending tags are
read once, and elements nested beyond ``MAX_DEPTH`` stand beside each other, with all text.

Defined results: null html is an empty page, with an empty text; a null url is a host of its
own; repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batch_limits, text_of

OPENING = re.compile(r"<(?=[!?/a-zA-Z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*))>", re.S)
SHORT_TOKEN = re.compile(r"<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>")
LOOSE_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:script|style|textarea|title)\b.*?(?:</(?:script|style|textarea|title)\b|\Z)|"
                       r"<(/?)(noscript|svg|select)(?=[\s/>])((?>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*))>", re.S | re.I)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements of HTML by their role here.
RAW = frozenset("script style title textarea noscript template iframe svg select xmp noembed noframes".split())
LOOSE = frozenset("noscript svg select".split())     # of these, dropped only if closed
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var label object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror
    mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts semantics annotation""".split())
BOILER = frozenset("nav footer aside form menu dialog button fieldset header".split())
MAIN = frozenset("article main".split())
PAGE = frozenset("html body".split())
#: Words of class and id names that tell what a part of a page is.
BOILER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice notices alert popup modal overlay sidebar sidebars aside widget widgets menu nav navbar navigation breadcrumb
    breadcrumbs footer masthead topbar toolbar comment comments discussion disqus respond reply replies form login signin signup
    newsletter subscribe subscription share sharing social related recommended search pagination pager skip copyright legal
    responses teaser teasers""".split())
#: Of these, words that inside an article tell boilerplate only if the part is mostly links.
SOFT_WORDS = frozenset("alert legal copyright search form popup modal overlay related recommended pagination pager skip".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
MAX_PERIOD = 4              # paths in a repeated group
MAX_DEPTH = 256             # open elements of a path; deeper ones stand beside each other, as in browsers
MAX_ITEMS = 4_000           # of a wrapper before items of equal paths become one repeat
DENSE = 1 << 16             # cells of an alignment table; between anchors further apart the next equal item is taken
REACH = 64                  # items between which that is looked for
SALTS = 32                  # groups in which partial wrappers of a host are joined first
MAX_HOSTS = 2_000           # wrappers that one task holds
MAX_CHOSEN = 2_000          # path sets of a host whose choice one task holds


def _closed(page: str) -> dict[int, int]:
    """Where the closed ``LOOSE`` elements of a page end, by where their content begins."""
    out: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for m in LOOSE_TAG.finditer(page):
        if (name := (m[2] or "").lower()) and m[1]:
            if stacks.get(name):
                out[stacks[name].pop()] = m.end()
        elif name and not m[3].endswith("/"):
            stacks.setdefault(name, []).append(m.end())
    return out


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, link characters) of the text blocks in page order, text as in the contract."""
    out: list[tuple[str, str, int]] = []
    stack: list[str] = []                                   # open elements that are not inline
    words: list[str] = []
    at = links = depth = 0
    beyond: list[str] = []                                  # names of open elements deeper than MAX_DEPTH
    known: dict[str, str] = {}                              # one string a path
    quotes = True                                           # until a tag's quotes don't end
    closed: dict[int, int] | None = None

    def close() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(words)).split()) if words else ""
        if text:
            path = "/".join(stack)
            out.append((known.setdefault(path, path), text, links))
        words.clear()
        links = 0

    def text(piece: str) -> None:
        nonlocal links
        words.append(piece)
        links += len(piece) * bool(depth)

    while (o := OPENING.search(page, at)):
        if o.start() > at:
            text(page[at:o.start()])
        m = TOKEN.match(page, o.start()) if quotes or page.startswith("<!--", o.start()) else SHORT_TOKEN.match(page, o.start())
        if m is None and quotes:
            # no end to be found from here on with quotes taken as such: without them, and this
            # holds for the rest of the page, so that each character is seen a few times at most
            quotes = False
            m = SHORT_TOKEN.match(page, o.start())
        if m is None:
            text("<")
            at = o.end()
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                depth = max(0, depth - 1)
            if name not in INLINE and beyond:
                close()
                if name in beyond:
                    del beyond[len(beyond) - 1 - beyond[::-1].index(name):]
            elif name not in INLINE:
                names = [e.split(" ", 1)[0] for e in stack]
                if name in names:
                    close()
                    del stack[len(names) - 1 - names[::-1].index(name):]
            continue
        if name in LOOSE:
            closed = _closed(page) if closed is None else closed
            at = closed.get(at, at)
        elif name in RAW and not (name == "iframe" and m[3].endswith("/")):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name in ("br", "wbr"):
            words.append(" " if name == "br" else "")
        elif name in INLINE or name == "iframe":
            depth += name == "a"
        elif name == "hr" or name not in VOID:
            close()
            closes = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                      "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ("p",))
            while stack and stack[-1].split(" ", 1)[0] in closes:
                stack.pop()
            if name != "hr" and len(stack) >= MAX_DEPTH:
                beyond = [*beyond[-MAX_DEPTH:], name]
                depth = 0
            elif name != "hr":
                found = " ".join(sorted(f"{k.lower()}={(a or b or c).strip().lower()}" for k, a, b, c in NAMES.findall(m[3])))
                stack.append(f"{name} {re.sub(r'[0-9]+', '0', found)}" if found else name)
                depth = 0
    text(page[at:])
    close()
    return out


# A wrapper is a list of items [paths, repeated, optional, pages, characters, link characters, texts];
# texts has for each path the checksum of its constant text or texts, or None for a slot.

def page_wrapper(found: list[tuple[str, str, int]]) -> list[list]:
    items: list[list] = []
    for path, text, links in found:
        items.append([[path], False, False, 1, len(text), links, [zlib.crc32(text.encode("utf-8", "surrogatepass"))]])
        _fold(items)
    return items


def _fold(items: list[list]) -> None:
    """Fold the end of the sequence: a group of paths that follows itself becomes a repeat."""
    for period in range(1, MAX_PERIOD + 1):
        last, before = items[-period:], items[-period - 1:-period]
        paths = [p for x in last for p in x[0]]
        if before and before[0][0] == paths and all(not x[1] or period == 1 for x in last):
            old = before[0]                                 # the group stands there already
            size, linked = sum(x[4] for x in last), sum(x[5] for x in last)
            items[-period - 1:] = [[paths, True, old[2], 1, old[4] + size, old[5] + linked, _joined(old, *last)]]
            return
        two = items[-2 * period:-period]
        if period > 1 and len(two) == period and [p for x in two for p in x[0]] == paths and not any(x[1] for x in two + last):
            items[-2 * period:] = [[paths, True, False, 1, sum(x[4] for x in two + last), sum(x[5] for x in two + last),
                                    _joined([0, 0, 0, 0, 0, 0, [s for x in two for s in x[6]]], *last)]]
            return


def _joined(old: list, *last: list) -> list[int]:
    """Checksums of all texts on the paths of a repeat, in their order."""
    return [zlib.crc32(f"{s} {t}".encode()) for s, t in zip(old[6], [t for x in last for t in x[6]])]


def _table_matches(a: list, b: list) -> list[tuple[int, int]]:
    """The longest common subsequence of two short lists."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _near_matches(a: list, b: list) -> list[tuple[int, int]]:
    """A common subsequence of long lists: each item takes the next equal one within REACH."""
    out, i = [], 0
    for j, key in enumerate(b):
        to = next((k for k in range(i, min(i + REACH, len(a))) if a[k] == key), None)
        if to is not None:
            out.append((to, j))
            i = to + 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of the first) whose seconds rise."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        x = bisect_left(tails, j)
        tails[x:x + 1], at[x:x + 1] = [j], [k]
        back.append(at[x - 1] if x else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Indices of equal items in a common subsequence: equal ends first, then items that are
    unique on both sides as anchors, and what lies between two anchors by a table if it is small.
    Memory is linear in the lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= DENSE:
            out += [(i + x, j + y) for x, y in _table_matches(a[i:n], b[j:m])]
            continue
        left, right = Counter(a[i:n]), Counter(b[j:m])
        where = {key: y for y, key in enumerate(b[j:m], j) if right[key] == 1}
        anchors = _rising([(x, where[key]) for x, key in enumerate(a[i:n], i) if left[key] == 1 and key in where])
        if not anchors:
            out += [(i + x, j + y) for x, y in _near_matches(a[i:n], b[j:m])]
            continue
        for x, y in anchors:
            out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        todo.append((i, n, j, m))
    return sorted(out)


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of both, by a common subsequence of their groups."""
    out, i, j = [], 0, 0
    for x, y in [*matches([tuple(k[0]) for k in a], [tuple(k[0]) for k in b]), (len(a), len(b))]:
        out += [[k[0], k[1], True, *k[3:]] for k in a[i:x] + b[j:y]]
        if x < len(a):
            out.append(_both(a[x], b[y]))
        i, j = x + 1, y + 1
    return _compact(out) if len(out) > MAX_ITEMS else out


def _both(x: list, y: list) -> list:
    return [x[0], x[1] or y[1], x[2] or y[2], x[3] + y[3], x[4] + y[4], x[5] + y[5], [s if s == t else None for s, t in zip(x[6], y[6])]]


def _compact(items: list[list]) -> list[list]:
    """A wrapper of many unlike sections: one repeat for all items of equal paths. Sizes stay."""
    held: dict[tuple, list] = {}
    for x in items:
        key = tuple(x[0])
        if key in held:
            pages = max(held[key][3], x[3])
            held[key] = [*_both(held[key], x)[:3], pages, *_both(held[key], x)[4:]]
            held[key][1] = True
        else:
            held[key] = x
    return list(held.values())


def _words(attributes: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"\b(class|id|role)=", " ", attributes))) - {""}


def _is_boiler(element: str, inside: bool) -> bool:
    name = element.partition(" ")[0]
    return name in BOILER and not (name == "header" and inside) or _has_boiler_words(element)


def _only_soft_words(element: str) -> bool:
    name, _, attributes = element.partition(" ")
    return name not in BOILER and _words(attributes) & BOILER_WORDS <= SOFT_WORDS


def _has_boiler_words(element: str) -> bool:
    name, _, attributes = element.partition(" ")
    return name not in PAGE | MAIN and bool(BOILER_WORDS & _words(attributes))


def _holders(own: frozenset[str], size: dict[str, list]) -> set[str]:
    """Elements (with their ancestors) whose class words do not count: they hold the page's
    article or main elements, and none stands in the clear beside them, or most of its text.
    An element with no other words than those of boilerplate needs the former."""
    inside: dict[str, float] = {}
    mains: set[str] = set()
    for path in own:
        elements = path.split("/")
        for i, e in enumerate(elements):
            prefix = "/".join(elements[:i + 1])
            inside[prefix] = inside.get(prefix, 0) + size[path][0]
            if e.split(" ", 1)[0] in MAIN:
                mains.add(prefix)
    total = sum(size[path][0] for path in own)
    out = set()
    for held, chars in inside.items():
        element = held.rpartition("/")[2]
        form = element.split(" ", 1)[0] == "form"           # some pages are one form
        if not form and not _has_boiler_words(element):
            continue
        above = held.split("/")
        beside = [m.split("/") for m in mains if not (m + "/").startswith(held + "/") and not (held + "/").startswith(m + "/")]
        if any((m + "/").startswith(held + "/") for m in mains):
            clear = (not any(_is_boiler(e, False) for e, a in zip(m, [*above, *[None] * len(m)]) if e != a) for m in beside)
            if not any(clear):
                out.add(held)
        elif chars > total / 2 and (form or _words(element.partition(" ")[2]) - BOILER_WORDS):
            out.add(held)
    return out


def _is_main(element: str) -> bool:
    name, _, attributes = element.partition(" ")
    return name in MAIN or name not in PAGE and bool(MAIN_WORDS & _words(attributes))


def path_sizes(wrapper: list[list]) -> dict[str, list]:
    """Characters, link characters, pages and whether the text is constant of each path of a host."""
    size: dict[str, list] = {}
    for paths, _, _, pages, chars, linked, texts in wrapper:
        for path, own in zip(paths, texts):
            s = size.setdefault(path, [0, 0, 0, True])
            s[0] += chars / len(paths)
            s[1] += linked / len(paths)
            s[2] = max(s[2], pages)
            s[3] &= own is not None
    return size


def _container(paths: list[str], size: dict[str, list]) -> list[str]:
    """The paths under the deepest container with most of the text that is not constant, and
    headings and paragraphs that stand directly beside it or in an element around it."""
    paths = [p for p in paths if not (size[p][3] and size[p][2] >= 3)] or paths
    total = sum(size[p][0] for p in paths)
    inside: dict[str, float] = {}
    for p in paths:
        elements = p.split("/")
        for i in range(1, len(elements) + 1):
            prefix = "/".join(elements[:i])
            inside[prefix] = inside.get(prefix, 0) + size[p][0]
    held = [p for p, chars in inside.items() if chars >= 0.6 * total and p not in size]
    root = max(held, key=lambda p: (p.count("/"), p)) if held else ""
    around = {"/".join(root.split("/")[:i]) for i in range(root.count("/") + 1)}
    return [p for p in paths if not root or p.startswith(root + "/")
            or p.rpartition("/")[0] in around and p.rpartition("/")[2].split(" ", 1)[0] in TEXT]


def content_paths(own: frozenset[str], size: dict[str, list]) -> set[str]:
    """The paths of a page's own that hold the article, by the sizes of its host: pages of
    several templates on a host each have their article."""
    plain: list[str] = []
    rooted: list[str] = []
    tagged = False
    holders = _holders(own, size)
    varied = not all(s[3] for s in size.values())
    for path in sorted(own):
        elements = path.split("/")
        chars, linked, pages, constant = size[path]
        first = next((i for i, e in enumerate(elements) if _is_main(e)), len(elements))
        boiler = [i for i, e in enumerate(elements) if _is_boiler(e, i > first)]
        boiler = [i for i in boiler if not (i > first and linked <= chars / 2 and _only_soft_words(elements[i]))]
        if any(elements[i].split(" ", 1)[0] in BOILER - {"form"} or "/".join(elements[:i + 1]) not in holders for i in boiler):
            continue
        if linked > chars / 2 and (first == len(elements) or constant and pages >= 3 and varied):
            continue                                        # a menu; in an article only if it is the same on all pages
        plain.append(path)
        if first < len(elements):
            rooted.append(path)
            tagged |= any(e.split(" ", 1)[0] in MAIN for e in elements)
    if tagged or sum(size[p][0] for p in rooted) > sum(size[p][0] for p in plain) / 2:
        return set(rooted)
    return {*rooted, *_container(plain, size)}


def host_of() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) for every host of ``pages``."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(h, json.dumps(w)) for h, w in held.items()], columns=["host", "wrapper"])
            held.clear()
            return out

        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"]):
                own = page_wrapper(blocks(page))
                held[host] = align(held[host], own) if host in held else own
                if len(held) >= MAX_HOSTS:
                    yield rows()
        yield rows()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        wrappers = sorted(pdf["wrapper"])
        out = json.loads(wrappers[0])
        for w in wrappers[1:]:
            out = align(out, json.loads(w))
        return pd.DataFrame({"host": pdf["host"][:1].to_numpy(), "wrapper": [json.dumps(out)]})

    batch_limits(pages.sparkSession)
    parts = pages.select(host_of().alias("host"), text_of("html").alias("html")).mapInPandas(partial, "host string, wrapper string")
    salted = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return salted.applyInPandas(join, "host string, wrapper string").groupBy("host").applyInPandas(join, "host string, wrapper string")


def main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text for every row."""
    wrappers = infer(pages) if wrappers is None else wrappers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, size, chosen = None, {}, {}
        for pdf in batches:
            out = []
            for page, wrapper in zip(pdf["html"], pdf["wrapper"]):
                if wrapper != last:
                    last, size, chosen = wrapper, path_sizes(json.loads(wrapper)), {}
                found = blocks(page)
                own = frozenset(path for path, _, _ in found)
                if own not in chosen:
                    if len(chosen) >= MAX_CHOSEN:
                        chosen.clear()
                    chosen[own] = content_paths(own, size)
                out.append("\n\n".join(text for path, text, _ in found if path in chosen[own]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out})

    # the second key makes both sides plain exchanges, so that a hot host can be split
    own = pages.select("page_id", "url", text_of("html").alias("html"), host_of().alias("host")).withColumn("length", F.length("host"))
    return (own.join(wrappers.withColumn("length", F.length("host")), ["host", "length"])
            .select("page_id", "url", "html", "wrapper").mapInPandas(run, "page_id long, url string, text string"))
