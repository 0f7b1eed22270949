"""Order MinHash with rows that share an id, have none, or are repeated very often."""

from collections import Counter

import pytest
from helpers import frame
from test_operators import brute_edit, sha

from ledgerflow.llm import order_minhash


def brute(rows):
    sign, want, known = order_minhash.signature, Counter(), {}
    for (i, t), n in Counter(rows).items():
        known[(i, t)] = n
    for i, t, edited, nxt in brute_edit(list(known)):
        a, b, c = sign(t), sign(edited), sign(nxt)
        want[(i, len(t), sha(edited), a.tobytes().hex(), b.tobytes().hex(), order_minhash.likeness(a, b),
              order_minhash.likeness(a, c))] += known[(i, t)]
    return want


def words(k):
    return " ".join(f"w{k * 7919 % 101}x{j * k % 17}" for j in range(k % 23))


CASES = {
    "ids": [(k, words(k)) for k in range(60)],
    "one id, many texts": [(k, words(k)) for k in range(30)] + [(12, words(100 + k)) for k in range(60)],
    "smallest and largest id": [(0, words(k)) for k in range(40)] + [(9, words(50 + k)) for k in range(40)] + [(5, "m")],
    "no ids": [(None, words(k)) for k in range(70)],
    "ids and none": [(k, words(k)) for k in range(30)] + [(None, words(200 + k)) for k in range(50)] + [(None, "")] * 9,
    "a repeated row": [(k, words(k)) for k in range(30)] + [(7, "same text again")] * 9_000,
    "a repeated row without id": [(k, words(k)) for k in range(5)] + [(None, "same text again")] * 5_000,
    "only one document": [(3, "alone here")] * 5,
    "negative ids": [(-(1 << 63), "a b c d e f g"), ((1 << 63) - 1, "h i j"), (-1, "k"), (-1, "l"), (0, "m")] * 3,
}


@pytest.mark.parametrize("case", CASES)
def test_order_minhash_with_hot_ids(spark, case):
    docs = frame(spark, [(i, t, "en", "a") for i, t in CASES[case]]).repartition(5)
    assert Counter(map(tuple, order_minhash.with_edits(docs).collect())) == brute(CASES[case])


def test_hot_ids_and_rows_without_one_have_many_chunks(spark):
    cuts = [1, 4, 4, 4, 4, 8]
    chunks = order_minhash.Chunks(cuts, 16)
    rows = [(i, d) for i in (None, 0, 1, 2, 4, 5, 8, 9) for d in range(0, 1 << 32, 1 << 26)]
    hot = spark.createDataFrame(rows, "doc_id long, d long").selectExpr(
        "doc_id", "d", "CASE WHEN doc_id IS NULL OR doc_id = 4 THEN d END AS part")
    got = [(r.doc_id, r.d, r.chunk) for r in hot.select("doc_id", "d", chunks.number()("doc_id", "part").alias("chunk")).collect()]
    held = {i: {c for x, _, c in got if x == i} for i in (None, 0, 1, 2, 4, 5, 8, 9)}
    assert len(held[None]) == 16 and len(held[4]) == 4 and all(len(held[i]) == 1 for i in (0, 1, 2, 5, 8, 9))
    order = sorted(got, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [c for *_, c in order] == sorted(c for *_, c in got)
