"""Token ids with markers, held against the plain call of the JSON tokenizer."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import frame
from tokenizers import Tokenizer

from ledgerflow.llm import packing

PLAIN = Tokenizer.from_file(packing.VOCABULARY)
MARK = "<|endoftext|>"


def plain(text):
    return [*PLAIN.encode(text, add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(public_tokenizers.path(packing.RANKS), packing.markers_of(packing.VOCABULARY))


def test_markers_have_their_own_id(tokens):
    assert packing.markers_of(packing.VOCABULARY) == {MARK: 50256}
    for text in (MARK, MARK * 3, f"a {MARK} b", f"  {MARK}  ", f"<|endof{MARK}text|>", f"{MARK[:-1]} {MARK}>", f"\n\n{MARK}\n", "", "a b"):
        assert tokens.ids(text).tolist() == plain(text)
    assert 50256 in tokens.ids(f"a {MARK} b") and 50256 not in packing.Tokens(public_tokenizers.path(packing.RANKS)).ids(f"a {MARK} b")


@pytest.mark.parametrize("limit", [3, 1 << 16])
def test_markers_in_random_texts(tokens, monkeypatch, limit):
    monkeypatch.setattr(packing, "PART", limit)
    rng = random.Random(limit)
    for _ in range(300):
        text = "".join(rng.choice([MARK, "a", " ", "  ", "\n", "'s", "12", "é", "漢", "!", "\x1c", "\xa0", "Word", MARK[:-2]]) for _ in range(25))
        assert tokens.ids(text).tolist() == plain(text)


def test_very_long_texts_of_markers_and_white_space(tokens):
    for text in (MARK * 200_000, f"{' ' * 1_000_100}{MARK}{chr(10) * 1_000_100}x"):
        assert tokens.ids(text).tolist() == plain(text)


def test_packed_pieces_hold_the_plain_ids(spark):
    rows = [(1, f"a {MARK} b", "en", "a"), (2, MARK, "en", "a"), (3, None, None, None), (None, f"{MARK}\n" * 300, "en", "b")]
    got = packing.pack(frame(spark, rows), length=64, markers=packing.markers_of(packing.VOCABULARY)).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["start"]):
        by[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert by == {i: plain(t or "") for i, t, *_ in rows}
