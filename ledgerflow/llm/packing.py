"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A piece of L tokens costs ``linear * L + quadratic * L * L`` (attention stays inside a piece).
Each task streams its rows and packs windows of them: full-length pieces of long documents are
sequences of their own; the rest, longest first, go to the cheapest sequence with room for the
whole piece; pieces that fit nowhere are cut to fill the cheapest gaps. A window opens only as
many sequences as it fills, and what is left over opens the next window, so no window pads.
The last tokens of a task (fewer than one sequence) are cut into sequences whose lengths are
powers of two, which need no padding either. Nothing is shuffled and a task holds one window,
so a lost task is simply run again.

Token ids are those of the vocabulary's byte-level BPE. Very long texts are encoded in parts,
cut in front of a single space between words, where pre-tokenisation always ends a piece. Long
white-space runs, which would exhaust the pattern's stack, are pieces of their own: all but the
last character of a run, or all of it at the end of the text. Markers (text that a vocabulary gives
an id of its own) are ordinary text unless they are named; named ones part the text they stand in.

Defined results: null text is the empty text, whose one token is the end mark; repeated rows
are packed as often as they come; rows without an id are packed with a null id; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerflow.llm.common import batch_limits, text_of

CUT = re.compile(r"(?<=\S) (?=\S)")
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"     # what \s is in the pattern
RUN = 1 << 16               # white-space characters in a row from which a run is encoded apart
PART = 1 << 20              # code points encoded at a time, up to the next safe cut
WINDOW = 2_048              # pieces that are packed together
END = 0                     # the id behind each document
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = "byte_bpe_50k.tiktoken"      # the same vocabulary as ranks


def markers_of(vocabulary: str) -> dict[str, int]:
    """The markers of a JSON vocabulary, as its tokenizer finds them in a plain call."""
    with open(vocabulary, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError("markers that take in their surroundings")
    return {a["content"]: a["id"] for a in added}


class Tokens:
    """Token ids of texts; long texts in parts, which bounds the memory of an encoding."""

    def __init__(self, ranks: str, markers: dict[str, int] | None = None):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode, self.encode_run = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_to_numpy
            for name, pattern in (("ranks", public_tokenizers.PATTERN), ("runs", r"\s+")))
        self.runs = re.compile(rf"(?<![{WHITE}])[{WHITE}]{{{RUN},}}")
        self.markers = markers or {}
        self.marked = re.compile("|".join(map(re.escape, sorted(self.markers, key=len, reverse=True))))

    def ids(self, text: str) -> np.ndarray:
        """The ids of ``text`` and the end mark."""
        parts, lo = [], 0
        for mark in self.marked.finditer(text) if self.markers else ():
            parts += [*self._runs(text[lo:mark.start()]), [self.markers[mark.group()]]]
            lo = mark.end()
        return np.concatenate([*parts, *self._runs(text[lo:]), [END]]).astype("<u4")

    def _runs(self, text: str) -> list[np.ndarray]:
        parts, lo = [], 0
        for run in self.runs.finditer(text) if len(text) >= RUN else ():
            end = run.end() - (run.end() < len(text))           # the last character goes with what follows
            parts += [*self._parts(text[lo:run.start()]), self.encode_run(text[run.start():end], disallowed_special=())]
            lo = end
        return [*parts, *self._parts(text[lo:])]

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        lo = 0
        while len(text) - lo > PART and (cut := CUT.search(text, lo + PART)):
            yield self.encode(text[lo:cut.start()], disallowed_special=())
            lo = cut.start()
        yield self.encode(text[lo:], disallowed_special=())


class Packer:
    """Packs pieces (doc_id, doc_tokens, start, ids); finished sequences leave as rows."""

    def __init__(self, length: int, linear: float, quadratic: float, first_id: int):
        self.length, self.linear, self.quadratic, self.next_id = length, linear, quadratic, first_id
        self.waiting: list[tuple] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.length
        for at in range(0, whole, self.length):
            self._emit([(doc, len(ids), at, ids[at:at + self.length])])
        if whole < len(ids):
            self.waiting.append((doc, len(ids), whole, ids[whole:]))
        if len(self.waiting) >= WINDOW:
            self.window([self.length] * (sum(len(p[3]) for p in self.waiting) // self.length))

    def finish(self) -> None:
        total = sum(len(p[3]) for p in self.waiting)
        self.window([self.length] * (total // self.length))
        left = total % self.length
        self.window([1 << b for b in reversed(range(left.bit_length())) if left >> b & 1])

    def window(self, room: list[int]) -> None:
        """Fill sequences of these lengths from the waiting pieces; the rest goes on waiting."""
        if not room:
            return
        free, cost = np.array(room), np.zeros(len(room))
        packed: list[list[tuple]] = [[] for _ in room]
        over = []

        def put(at: int, piece: tuple) -> None:
            n = len(piece[3])
            packed[at].append(piece)
            free[at] -= n
            cost[at] += self.linear * n + self.quadratic * n * n

        for piece in sorted(self.waiting, key=lambda p: -len(p[3])):
            at = int(np.argmin(np.where(free >= len(piece[3]), cost, np.inf)))
            if free[at] >= len(piece[3]):
                put(at, piece)
            else:
                over.append(piece)
        self.waiting = []
        gaps = [int(i) for i in np.argsort(cost, kind="stable")[::-1] if free[i]]   # the cheapest last
        for doc, total, start, ids in over:
            while len(ids) and gaps:
                n = min(len(ids), int(free[gaps[-1]]))
                put(gaps[-1], (doc, total, start, ids[:n]))
                start, ids = start + n, ids[n:]
                if not free[gaps[-1]]:
                    gaps.pop()
            if len(ids):
                self.waiting.append((doc, total, start, ids))
        for pieces in packed:
            self._emit(pieces)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, ranks: str | None = None, length: int = 1024, linear: float = 1.0,
         quadratic: float = 1 / 512, markers: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset. ``ranks`` is the place of the vocabulary on every executor; ``markers``
    are the texts with an id of their own (none by default)."""
    place = ranks or public_tokenizers.path(RANKS)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, packer = None, Packer(length, linear, quadratic, TaskContext.get().partitionId() << 36)

        def rows() -> pd.DataFrame:
            out, packer.rows = packer.rows, []
            return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

        for pdf in batches:
            tokens = tokens or Tokens(place, markers)
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                packer.add(None if pd.isna(doc) else int(doc), tokens.ids(text))
                if len(packer.rows) >= 4096:
                    yield rows()
        packer.finish()
        yield rows()

    batch_limits(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, SCHEMA)
