"""HTML extraction: pages in one form, parts beside the article's container, words inside an
article, and long, deep or malformed pages in bounded time and memory."""

import random
import time
import tracemalloc

import pytest
from test_operators import extracted, framed

from ledgerflow.llm import wrappers


@pytest.mark.parametrize("form", ["form id=aspnetForm", "form class='page login-form'"])
@pytest.mark.parametrize("root", ["article", "div class=text"])
def test_pages_inside_a_form(spark, form, root):
    pages = [f"<body><{form}><nav><a>Home</a></nav><{root}><h1>Head {i}</h1><p>the running text {i} of the page</p><p>more of it {i}</p>"
             f"<form><label>Mail {i}</label></form></{root.split()[0]}><footer>Imprint</footer></form></body>" for i in range(4)]
    assert extracted(spark, pages) == [f"Head {i}\n\nthe running text {i} of the page\n\nmore of it {i}" for i in range(4)]


def test_title_intro_and_closing_beside_the_container(spark):
    pages = [f"<body><div class=top><a>Home</a></div><div class=page><h1>Head {i}</h1><p>intro {i}<div class=text>"
             + "".join(f"<p>long running paragraph {i} {j} of the page</p>" for j in range(8))
             + f"</div><p>closing {i}</p></div><p>The same on each page</p></body>" for i in range(4)]
    want = [[f"Head {i}", f"intro {i}", *(f"long running paragraph {i} {j} of the page" for j in range(8)), f"closing {i}"] for i in range(4)]
    assert extracted(spark, pages) == ["\n\n".join(x) for x in want]


@pytest.mark.parametrize("name", ["alert", "legal", "related-work", "search results"])
def test_soft_words_inside_an_article(spark, name):
    pages = [framed(f"<article><h1>Head {i}</h1><p class='{name}'>kept text {i}</p><div class='{name}'><a>link {i}</a></div></article>", i) for i in range(4)]
    assert extracted(spark, pages) == [f"Head {i}\n\nkept text {i}" for i in range(4)]


def test_reader_comments_and_teasers(spark):
    pages = [framed(f"<article><h1>Head {i}</h1><p>text {i}</p><ol class=responses><li>Nice {i}</ol><ul class='teaser-list'><li>Next {i}</ul></article>", i)
             for i in range(4)]
    assert extracted(spark, pages) == [f"Head {i}\n\ntext {i}" for i in range(4)]


PIECES = {"open": "<a ", "quote": '<a "', "quotes": "<a '\"", "mark": "<!", "svg": "<svg ", "less": "< ", "close": "</"}


@pytest.mark.parametrize("piece", sorted(PIECES))
def test_a_megabyte_of_openings(piece):
    start = time.time()
    wrappers.blocks("<p>text</p>" + PIECES[piece] * ((1 << 20) // len(PIECES[piece])))
    assert time.time() - start < 20


def test_text_stays_behind_quotes_that_do_not_end():
    assert [t for _, t, _ in wrappers.blocks("<p>one</p><p title=\"x>two</p><p>three</p><p class='b'>four</p>")][-2:] == ["three", "four"]


def test_a_hundred_thousand_unclosed_elements():
    tracemalloc.start()
    found = wrappers.blocks("".join(f"<div>text {i}" for i in range(100_000)) + "</div><p>end")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t for _, t, _ in found] == [*(f"text {i}" for i in range(100_000)), "end"]
    assert peak < 200 << 20 and max(p.count("/") for p, _, _ in found) < wrappers.MAX_DEPTH


def unlike(seed, n=60_000):
    r = random.Random(seed)
    return "<body>" + "".join(f"<{(k := r.choice(['p', 'h2', 'h3', 'ul', 'pre', 'dl']))} class=c{r.choice('abcdef')}>some text {i} of it</{k}>" for i in range(n))


def test_two_megabytes_of_unlike_sections():
    one, two = (wrappers.page_wrapper(wrappers.blocks(unlike(s))) for s in (1, 2))
    tracemalloc.start()
    start, both = time.time(), wrappers.align(one, two)
    again = wrappers.align(both, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - start < 60 and peak < 200 << 20
    assert len(both) <= wrappers.MAX_ITEMS and len(again) <= wrappers.MAX_ITEMS
    assert sum(x[4] for x in both) == sum(x[4] for x in one + two)


@pytest.mark.parametrize("dense", [1 << 16, 0, 40])
def test_matches_are_a_common_subsequence(monkeypatch, dense):
    monkeypatch.setattr(wrappers, "DENSE", dense)
    r = random.Random(dense)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh" if r.random() < 0.7 else "uvwxyz") for _ in range(r.randint(0, 30))] for _ in range(2))
        found = wrappers.matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        if dense == 1 << 16:
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            assert len(found) == best[-1][-1]
