"""Secret scans through a trigram inverted index.

From each rule's pattern ``trigram_query`` derives the trigrams that every match must hold: a
conjunction of clauses, each a choice between sets of trigrams. Documents are indexed in
segments (a few MB of text each): a posting list per trigram that some rule asks for. A rule's
candidates are the postings' intersections and unions; only they are verified by the pattern.
Rules without a mandatory trigram scan every document. Segments are independent, so nothing is
shuffled and a task holds one segment.

Spans are in code points, the end exclusive, leftmost and without overlap for each rule.
Defined results: null text is the empty text, without spans; repeated rows get equal results;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ledgerflow.llm.common import batch_limits, text_of

SEGMENT = 1 << 22           # bytes of text in one segment
MAX_STRINGS = 64            # alternatives of one run of letters before it is cut


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, otherwise the match is dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),              # a shorter run never qualifies
)
#: Public formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def _strings(code, arg) -> set[str] | None:
    """All strings that a node can match, in lower case; None if there are too many."""
    if code is op.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if code is op.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is op.LITERAL and value < 128:
                chars.add(chr(value).lower())
            elif kind is op.RANGE and value[1] < 128 and value[1] - value[0] < 4:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if code is op.SUBPATTERN:
        return _sequence(arg[3])
    if code is op.BRANCH:
        sets = [_sequence(x) for x in arg[1]]
        return None if None in sets else set().union(*sets)
    if code is op.AT:
        return {""}
    if code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for code, arg in items:
        own = _strings(code, arg)
        if own is None or len(out) * len(own) > MAX_STRINGS:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all must hold; a clause holds if all trigrams of one of its sets are there.
    No clause: the pattern has no mandatory trigram."""
    clauses: list[list[frozenset[str]]] = []

    def close(run: set[str]) -> None:
        if run and min(map(len, run)) >= 3:
            sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    def walk(items) -> None:
        run = {""}
        for code, arg in items:
            own = _strings(code, arg)
            if own is not None and len(run) * len(own) <= MAX_STRINGS:
                run = {a + b for a, b in product(run, own)}
                continue
            close(run)
            run = own if own is not None else {""}
            if own is None and code is op.SUBPATTERN:
                walk(arg[3])
            elif own is None and code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        close(run)

    walk(parser.parse(pattern))
    return clauses


class Index:
    """Posting lists of one segment for the trigrams that are asked for."""

    def __init__(self, texts: list[str], wanted: list[str], table: np.ndarray):
        data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        starts = np.cumsum([0, *(len(d) + 1 for d in data)])
        joined = np.frombuffer(b"\x00".join(data), dtype=np.uint8)
        hits = []
        for lo in range(0, len(joined), SEGMENT):                      # one long text is read in parts
            part = joined[lo:lo + SEGMENT + 2].astype(np.uint32)
            if len(part) >= 3:
                found = table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
                at = np.flatnonzero(found)
                doc = np.searchsorted(starts, at + lo, "right") - 1
                hits.append(np.unique(found[at].astype(np.int64) * len(texts) + doc))
        found = np.unique(np.concatenate(hits or [np.zeros(0, np.int64)]))
        which, doc = np.divmod(found, max(1, len(texts)))
        bounds = np.searchsorted(which, np.arange(1, len(wanted) + 2))
        self.lists = {t: doc[bounds[i]:bounds[i + 1]] for i, t in enumerate(wanted)}

    def candidates(self, clauses: list[list[frozenset[str]]], n: int) -> np.ndarray:
        out = np.arange(n)
        for clause in clauses:
            either = np.zeros(0, np.int64)
            for trigrams in clause:
                all_of = out
                for t in sorted(trigrams, key=lambda t: len(self.lists[t])):
                    all_of = np.intersect1d(all_of, self.lists[t], assume_unique=True)
                either = np.union1d(either, all_of)
            out = either
        return out.astype(np.int64)


def _segments(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SEGMENT:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    yield lo, texts[lo:]


def scan_texts(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, place of the rule, end), sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for clauses in queries for clause in clauses for s in clause for t in s})
    table = np.zeros(1 << 24, dtype=np.uint16)
    for i, t in enumerate(wanted):
        a, b, c = t.encode()
        table[a << 16 | b << 8 | c] = i + 1
    compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for lo, part in _segments(texts):
        index = Index(part, wanted, table)
        for at, (rule, find, clauses) in enumerate(zip(rules, compiled, queries)):
            for doc in index.candidates(clauses, len(part)):
                for m in find.finditer(part[doc]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[lo + doc].append((m.start(), at, m.end()))
    for s in spans:
        s.sort()
    return spans


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end) for every row, by start and the rules' order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = scan_texts(pdf["text"].tolist(), rules)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": [
                [{"kind": rules[at].kind, "start": start, "end": end} for start, at, end in s] for s in found]})

    batch_limits(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
