"""URL filter, whitening and divergence audit against brute-force forms, on edge cases."""

import math
import re
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction
from urllib.parse import urljoin

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import LONG, ROWS, frame, lower
from test_oracle import _canon

from ledgerflow.llm import divergence, url_filter, whitening
from ledgerflow.llm.queries import OP11_SQL, OP13_SQL, URL_RULES

SF = "/root/testdata/sf0.001"


# ---- URL filter

def canonical(url):
    return f"<head><link rel='canonical' href='{url}'></head>"


def refresh(url):
    return f'<meta http-equiv="refresh" content="0; url={url}"><p>moved'


#: page, html, verdict, inherited. Example: a chain of aliases leads from a.net over b.net to a blocked url.
PAGES = [
    ("http://a.net/1", canonical("https://b.net/2"), "block", True),
    ("https://B.net/2#top", refresh("http://x.com/de/9"), "block", True),
    ("http://x.com/de/9", "", "block", False),
    ("http://c.net/3", refresh("https://b.net/2"), "block", True),
    ("http://ok.org/p", canonical("http://a.net/1"), "allow", False),           # its rule allows it
    ("http://d.net/4", canonical("http://ok.org/p"), "block", True),
    ("http://e.net/5", canonical("http://f.net/6"), "allow", False),
    ("http://g.net/7", canonical("http://shop.example.org/es/x"), "block", True),   # the target is no page
    ("http://example.org/en/1234", None, "block", False),
    ("http://notexample.org/es/1", None, "allow", False),
    ("http://h.com/fr/8", canonical("http://x.com/de/9"), "allow", False),
    ("HTTP://WWW.Example.ORG/es/?q#f", "x", "block", False),
    ("http://example.org", None, "allow", False),
    ("no scheme", canonical("http://x.com/de/9"), "allow", False), ("", None, "allow", False), (None, "", "allow", False),
    ("http://j.net/a\nb", None, "allow", False), ("http://x.com/de/9", "", "block", False),
    ("http://k.net/9", "<p>" + LONG * 3 + canonical("http://c.net/3"), "block", True),
]
#: The same with links that the SQL form doesn't read.
RELATIVE = [
    ("http://i.net/8", "<!--" + canonical("http://x.com/de/9") + "--><script>" + refresh("http://x.com/de/9") + "</script>", "allow", False),
    ("http://l.com/de/1", "", "block", False),
    ("http://l.com/en/2", canonical("/de/1#x"), "block", True),
    ("http://l.com/en/3/", canonical("../2"), "block", True),
    ("http://l.com/en/4", "<base href='http://l.com/de/'>" + canonical("1"), "block", True),
    ("http://m.com/en/5", canonical("//l.com/de/1"), "block", True),
    ("http://m.com/en/6", "<LINK href=http://l.com/de/1 REL='shortlink Canonical'>", "block", True),
    ("http://m.com/en/7", "<meta content='5;URL=&#39;http://l.com/de/1&#39;' http-equiv=Refresh>", "block", True),
    ("http://m.com/en/8", "<meta http-equiv=refresh content=30>" + canonical("") + canonical("http://[half"), "allow", False),
    ("http://m.com/en/9", "<link rel=canonical href='" + "http://l.com/de/1", "allow", False),
    ("http://m.com/en/10", "<link rel=stylesheet href='http://l.com/de/1'><a href='http://l.com/de/1'>", "allow", False),
]


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", 1) for i, (u, h, *_) in enumerate(rows)],
                                 "page_id long, url string, html string, key string, alias string, root long")


@pytest.mark.parametrize("rows", [PAGES, PAGES + RELATIVE, []])
def test_url_filter(spark, rows):
    df = pages_frame(spark, rows)
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, URL_RULES).collect()}
    assert [(got[i]["verdict"], got[i]["inherited"]) for i in range(len(rows))] == [(v, inh) for *_, v, inh in rows]
    for i, (u, *_) in enumerate(rows):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        assert (got[i]["host"], got[i]["path"]) == ((lower(m[1]), m[2]) if m else ("", ""))
        fits = [r for r in URL_RULES if ("." + got[i]["host"]).endswith("." + r.host) and got[i]["path"].startswith(r.path)]
        assert got[i]["rule"] == max((r.name for r in fits), key=len, default=None)


def test_url_filter_sql(spark):
    df = pages_frame(spark, PAGES)
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas())
    assert _canon(url_filter.judge_urls(df, URL_RULES).drop("url").toPandas()) == _canon(con.execute(OP11_SQL).df())


def test_url_filter_with_known_links_and_a_hub(spark):
    """A target that most pages name, and redirects from a log."""
    rows = [(f"http://n{i}.net/", canonical("http://hub.net/")) for i in range(3000)] + [("http://o.net/", None)]
    log = spark.createDataFrame([("http://hub.net/#a", "http://z.com/de/"), ("http://o.net/", None), (None, "http://z.com/de/")],
                                "a string, b string")
    df = pages_frame(spark, rows)
    assert Counter(r["verdict"] for r in url_filter.judge_urls(df, URL_RULES).collect()) == {"allow": 3001}
    assert Counter(r["verdict"] for r in url_filter.judge_urls(df, URL_RULES, log).collect()) == {"block": 3000, "allow": 1}


def test_links_of_hostile_pages():
    """Long runs of openings cost their length."""
    for piece in ("<link ", "<link rel='", "<!--", "<script>", "<meta content=\"", "<", "<base href="):
        assert url_filter.linked_urls(piece * 200_000, "http://a.net/") == []
    assert url_filter.linked_urls("<script>" + canonical("http://b.net/"), "http://a.net/") == []
    assert url_filter.linked_urls(canonical("b?x=1&amp;y=2"), "http://a.net/c/d") == [urljoin("http://a.net/c/d", "b?x=1&y=2")]


# ---- whitening

def brute(rows, count=4, scale=256):
    """vec_id -> per component (n, deviation, |whitened|, explained), with exact covariances."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(max(-2 ** 63, min(2 ** 63 - 1, math.floor(scale * np.float64(c)))) for c in v)) for i, v in kept]
    fit = set(x for _, x in xs)
    sizes = Counter(map(len, fit))
    d = max(sizes, key=lambda k: (sizes[k], k), default=0)
    fit = [x for x in fit if len(x) == d]
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    cov = [[sum((Fraction(x[a]) - Fraction(sums[a], n)) * (Fraction(x[b]) - Fraction(sums[b], n)) for x in fit) / n for b in range(d)]
           for a in range(d)]
    if not d:
        return {i: [None] for i, _ in xs}
    e, u = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    e, u, trace = e[::-1][:count], u.T[::-1][:count], float(sum(cov[j][j] for j in range(d)))
    out = defaultdict(list)
    for i, x in xs:
        if len(x) != d:
            out[i].append(None)
            continue
        centre = [float(Fraction(x[j]) - Fraction(sums[j], n)) for j in range(d)]
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        for k in range(len(e)):
            flat = e[k] <= 1e-12 * trace
            out[i].append((n, deviation, None if flat else abs(float(np.dot(centre, u[k]))) / math.sqrt(e[k]),
                           None if not trace else max(e[k] / trace, 0.0)))
    return out


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, 1 + np.arange(6))]) for i in range(200)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(90)]                     # copies count once in the fit list
    rows += [(1, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6),
             (2003, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (2004, [1.0, 2.0]), (2005, []), (2006, [-0.0] * 6), (2006, [-1e-9] * 6)]
    return rows


CASES = {"edges": vectors(), "empty": [], "one": [(1, [1.0, 2.0, 3.0])], "bare": [(1, []), (2, [])],
         "flat": [(i, [float(i), 2.0 * i, 7.0, -1.0, 0.0]) for i in range(9)],
         "huge": [(i, [(-1.0) ** i * 1e30, 1e17 + 4e15 * i, float(i)]) for i in range(12)],
         "wide sums": [(i, [3e9 * math.sin(i), 2e9 * math.cos(3 * i), 1e9 * math.sin(7 * i * i)]) for i in range(300)]}


@pytest.mark.parametrize("case", sorted(CASES))
def test_whitening(spark, case):
    rows, kind = CASES[case], "double" if case in ("huge", "wide sums") else "float"
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, x int, dims int")
    want, got = brute(rows), defaultdict(list)
    for r in whitening.whiten(df).collect():
        got[r["vec_id"]].append(r)
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items()}
    for i, found in got.items():
        exact = Counter(None if r["component"] is None else
                        (r["component"], r["n"], int(r["deviation_digits"] or r["deviation"])) for r in found)
        times = Counter()
        expected = defaultdict(list)
        for w in want[i]:
            k = None if w is None else (times[w[1]] % max(1, min(4, len(rows[0][1] or [])))) + 1
            if w is None:
                expected[None].append(None)
            else:
                times[w[1]] += 1
                expected[(k, w[0], w[1])].append(w)
        assert exact == Counter({k: len(v) for k, v in expected.items()})
        for r in found:
            if r["component"] is None:
                assert all(r[c] is None for c in r.asDict() if c != "vec_id")
                continue
            assert (r["deviation"] is None) == (r["deviation_digits"] is not None)
            _, _, white, share = expected[(r["component"], r["n"], int(r["deviation_digits"] or r["deviation"]))][0]
            assert (r["explained"] is None) == (share is None) and (share is None or abs(r["explained"] - share) < 1e-9)
            if case != "huge":
                assert (r["whitened"] is None) == (white is None) and (white is None or abs(abs(r["whitened"]) - white) < 1e-6 * (1 + white))
            assert r["identity_error"] is None or r["identity_error"] <= 1e-4


def test_whitening_of_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want, got = brute(rows), whitening.whiten(df).collect()
    assert len(got) == 4 * len(rows) and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for r in got:
        n, deviation, white, share = want[r["vec_id"]][r["component"] - 1]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - white) < 1e-9 and abs(r["explained"] - share) < 1e-9 * share


@pytest.mark.parametrize("bits", [4, 20, 26, 27, 40, 52, 60])
def test_square_sums(bits):
    t = np.random.default_rng(bits).integers(-(1 << bits), 1 << bits, (3, whitening.BLOCK))
    t[0, :] = (1 << bits) - 1
    assert [int(v) for v in whitening.square_sums(t)] == [sum(int(v) ** 2 for v in row) for row in t]


# ---- divergence audit

def audited(rows, min_docs=3, top=200):
    occ, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = lower(text or ""), lang or "", source or ""
        groups.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        occ[lang, source].update(found)
        docs[lang].update(found.keys())
    out = Counter()
    for lang in {g for g, _ in groups}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        own = {s: {t: n for t, n in occ[g, s].items() if t in kept} for g, s in groups if g == lang}
        every = Counter()
        for c in own.values():
            every.update(c)

        def p(counts):
            total = sum(counts.values()) + len(kept)
            return {t: 1 + 10 ** 9 * (counts.get(t, 0) + 1) // total for t in kept}

        ps, q = {s: p(c) for s, c in own.items()}, p(every)
        for s in own:
            pairs = [(-sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((ps[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in own[s] if ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                for i, (value, item) in enumerate(found):
                    out[(lang, s, part, item.decode(), -value, i + 1)] += 1
    return out


def edge_rows():
    rows = [(t, lang, s) for _, t, lang, s in ROWS]
    forms = ["Tree tree, (TREE)", "tree.", "x-tree y tree"]
    rows += [(f, "en", s) for f in forms for s in ("a", "b", "zoë")]            # forms of one term in few documents
    rows += [("leaf leaf, Leaf", "en", "a"), ("leaf (leaf)", "en", "b")]        # three forms, but in two documents
    rows += [("twig", "en", "a"), ("twig;", "en", "a"), ("twig!", "en", "b")]   # three forms, in three documents
    rows += [("é" * 5 + " z\u0085", "fr", "c")] * 3 + [("a-" * 20_000 + "b", "fr", "c")] * 3
    rows += [("1 2 3", "xx", "p"), ("", "xx", "q"), ("only once", "xx", "r"), ("alone", "yy", "p")] + [(None, None, None)] * 2
    return rows + [(f"w{i} v{i % 7} hot", "en", "a") for i in range(60)]


@pytest.mark.parametrize("min_docs, top, held", [(3, 200, 600_000), (1, 5, 50), (2, 3, 7), (5, 200, 1)])
def test_divergence(spark, monkeypatch, min_docs, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BYTES", held if held < 100 else divergence.BYTES)
    monkeypatch.setattr(divergence, "PAIRS", 16 if held < 100 else divergence.PAIRS)
    rows = edge_rows()
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)]).withColumn("term", df_clash()).withColumn("chunk", df_clash()).repartition(3)
    assert Counter(map(tuple, divergence.audit(df, min_docs, top).collect())) == audited(rows, min_docs, top)


def df_clash():
    from pyspark.sql import functions as F
    return F.lit("clash")


def test_divergence_sql(spark):
    rows = edge_rows()
    con = duckdb.connect()
    con.register("documents", frame(spark, [(i, *r) for i, r in enumerate(rows)]).select("text", "lang", "source").toPandas())
    assert Counter(tuple(r) for r in con.execute(OP13_SQL).fetchall()) == audited(rows)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_divergence_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    assert Counter(map(tuple, divergence.audit(df).collect())) == audited(rows)


def test_divergence_exchanges_chunks_counts_and_terms_once(spark, monkeypatch):
    """Only kept terms and measures are stored; the chunks' terms are cut once, where the chunks are counted."""
    plans, store = {}, divergence.store

    def stored(df, name):
        plans[name] = [p.toString() for p in (df._jdf.queryExecution().optimizedPlan(), df._jdf.queryExecution().executedPlan())]
        return store(df, name)

    monkeypatch.setattr(divergence, "store", stored)
    rows = edge_rows()
    assert Counter(map(tuple, divergence.audit(frame(spark, [(i, *r) for i, r in enumerate(rows)])).collect())) == audited(rows)
    assert list(plans) == ["terms", "measures"]
    assert plans["terms"][0].count("regexp_extract_all(") == 1
    assert plans["terms"][1].count("Exchange hashpartitioning") == 3


def test_divergence_counts_chunks_of_whole_texts(monkeypatch):
    """Arrow counts as bytes.split() does, in blocks of any size."""
    texts = ["", " \t A a\x1cB  b\x0b\x0c", "É é\u0085x  ", "a " * 50, "tree, Tree tree"] * 3
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t.encode() for t in texts])})
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(divergence, "BYTES", size)
        blocks = [b["text"] for b in divergence._blocks(iter([batch, batch]))]
        assert [t for b in blocks for t in b.to_pylist()] == [t.encode() for t in texts] * 2
        got = []
        for block in blocks:
            chunks, of, code, n = divergence._counts(block)
            own = [Counter() for _ in range(len(block))]
            for i, c, k in zip(of, code, n):
                own[i][chunks[int(c)].as_py().encode()] += int(k)
            got += own
        assert got == [Counter(t.encode().lower().split()) for t in texts] * 2


@pytest.mark.parametrize("held, held_bytes", [(600_000, 1 << 20), (600_000, 3_000), (40, 1 << 20)])
def test_divergence_adds_up_blocks_and_pieces(spark, monkeypatch, held, held_bytes):
    """Documents of a chunk in several blocks of a task are added up, whenever the counts leave it."""
    for name, value in (("HELD", held), ("HELD_BYTES", held_bytes), ("BYTES", 60), ("PIECE", 7), ("ROWS", 9)):
        monkeypatch.setattr(divergence, name, value)
    rows = edge_rows()
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)]).repartition(2)
    assert Counter(map(tuple, divergence.audit(df).collect())) == audited(rows)


def test_divergence_counts_in_little_memory():
    """Cutting and counting texts takes a few times their bytes, not ten times (one executor runs several such tasks)."""
    rng = np.random.default_rng(5)
    words = np.array([f"word{i}" for i in range(30_000)])
    texts = pa.array([" ".join(rng.choice(words, 500)).encode() for _ in range(2_000)])
    size, usual = pc.sum(pc.binary_length(texts)).as_py(), pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        _, of, _, n = divergence._counts(texts)
        taken = pool.max_memory() + tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)
    assert (n.sum(), of[-1]) == (1_000_000, 1_999)
    assert taken < 6 * size, taken / size
