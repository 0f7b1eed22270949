"""Language identification by a byte convolutional network.

Texts are lower-cased (ASCII) UTF-8 bytes, cut into windows of ``WINDOW`` bytes; the whole text
is read. Filters of widths 2, 3 and 4 slide over a window, each keeps its maximum, and a
softmax over the maxima gives the window's languages. A text's probabilities are the mean of
its windows', weighted by their bytes. The filters work on one-hot bytes, so a filter bank is a
table lookup; for prediction two neighbouring bytes share one lookup.

The network is trained in numpy on at most ``PER_LANG`` documents a language (those with the
smallest id hash) and ``PER_DOC`` windows of each, spread evenly over the text: that sample is
all that reaches the driver.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing was
learned; a null id is neither learned from nor held out; repeated rows get equal results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import batch_limits

WINDOW = 128                # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16                # per width
PER_LANG, PER_DOC = 500, 8  # bound of the training sample
EPOCHS, BATCH, RATE = 6, 64, 0.01
CHUNK = 512                 # windows predicted at a time


def windows_of(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace").lower()
    data += b"\x00" * (-len(data) % WINDOW)
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, WINDOW)


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]        # per width: (width, 256, FILTERS)
    bias: np.ndarray                 # of the filters, all widths
    dense: np.ndarray                # (features, languages)
    offset: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 0) -> Network:
    """Adam on the cross entropy; the maximum passes its gradient to one place per filter."""
    rng = np.random.default_rng(seed)
    n_features = FILTERS * len(WIDTHS)
    net = Network(langs, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(n_features, np.float32), rng.normal(0, 0.1, (n_features, len(langs))).astype(np.float32),
                  np.zeros(len(langs), np.float32))
    params = [*net.filters, net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), BATCH):
            x, y = windows[order[lo:lo + BATCH]], labels[order[lo:lo + BATCH]]
            tops, places = [], []
            for w, table in zip(WIDTHS, net.filters):
                out = sum(table[k][x[:, k:WINDOW - w + 1 + k]] for k in range(w))
                places.append(out.argmax(axis=1))
                tops.append(out.max(axis=1))
            raw = np.concatenate(tops, axis=1) + net.bias
            hidden = np.maximum(raw, 0)
            error = _softmax(hidden @ net.dense + net.offset)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ net.dense.T) * (raw > 0)
            grads = []
            for i, (w, table) in enumerate(zip(WIDTHS, net.filters)):
                g, own = np.zeros_like(table), back[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(w):
                    at = np.take_along_axis(x, places[i] + k, axis=1)
                    np.add.at(g[k], (at, np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


class Predictor:
    """The trained network with its lookups of byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        pair = lambda t, k: (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS)
        two, three, four = net.filters
        self.two, self.three, self.four, self.last, self.end = pair(two, 0), pair(three, 0), pair(four, 0), three[2], pair(four, 2)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (windows, languages)."""
        out = np.empty((len(x), len(self.net.langs)), np.float32)
        for lo in range(0, len(x), CHUNK):
            b = x[lo:lo + CHUNK]
            pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            wide = self.four[pairs[:, :-2]]
            wide += self.end[pairs[:, 2:]]
            middle = self.three[pairs[:, :-1]]
            middle += self.last[b[:, 2:]]
            tops = [self.two[pairs].max(axis=1), middle.max(axis=1), wide.max(axis=1)]
            hidden = np.maximum(np.concatenate(tops, axis=1) + self.net.bias, 0)
            out[lo:lo + CHUNK] = _softmax(hidden @ self.net.dense + self.net.offset)
        return out

    def text(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.net.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = windows_of(text)
        weight = np.full(len(x), float(WINDOW))
        weight[-1] = max(1, np.count_nonzero(x[-1]))
        mean = (weight / weight.sum()) @ self.windows(x)
        best = int(mean.argmax())
        return self.net.langs[best], float(min(1.0, max(0.0, mean[best])))


def _draw() -> Column:
    """63 random bits of an id, by another hash than approx_count_distinct counts with."""
    return F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit((1 << 63) - 1))


def low_draws(docs: DataFrame, per_lang: int) -> DataFrame:
    """lang, doc_id, draw of the ids with the lowest draws: at least twice ``per_lang`` of a
    language (or all), about four times at most, at any size of the table. One aggregate counts
    a language's ids by the magnitude of their draws and so finds the power of two to stay below."""
    drawn = docs.select("doc_id", "lang", _draw().alias("draw")).withColumn("magnitude", F.length(F.bin("draw")))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("magnitude"))
    levels = (drawn.groupBy("lang", "magnitude").agg(F.approx_count_distinct("doc_id").alias("n"))     # at most 64 a language
              .withColumn("before", below - F.col("n")).filter(F.col("before") < 2 * per_lang)
              .groupBy("lang").agg(F.max("magnitude").alias("top")))
    # one row a language, as many as the network has classes
    return drawn.join(F.broadcast(levels), "lang").filter("magnitude <= top").select("lang", "doc_id", "draw").distinct()


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> Network:
    """Train on the bounded sample of the rows of ``docs`` for which ``learn`` holds."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, text in zip(pdf["lang"], pdf["text"]):
                x = windows_of(text)
                for i in sorted({int(i) for i in np.linspace(0, len(x) - 1, PER_DOC)}) if len(x) else ():
                    rows.append((lang, x[i].tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "bytes"])

    own = docs.select("doc_id", "text", "lang", learn.alias("learn")).filter(
        "learn AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").drop("learn").withColumn("draw", _draw())
    first = Window.partitionBy("lang").orderBy("draw", "doc_id")
    # ids are chosen without their texts
    ranked = low_draws(own, per_lang).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_lang)
    chosen = F.broadcast(ranked.select("doc_id").distinct())           # at most per_lang ids a language
    sample = (own.join(chosen, "doc_id", "left_semi").withColumn("place", F.row_number().over(first))
              .filter(F.col("place") <= per_lang).select("lang", "text")
              .mapInPandas(cut, "lang string, bytes binary").distinct().collect())
    sample = sorted((r["lang"], bytes(r["bytes"])) for r in sample)
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return Network([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    x = np.frombuffer(b"".join(b for _, b in sample), dtype=np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([langs.index(lang) for lang, _ in sample]), langs)


def predictor(net: Network):
    """A column function: text -> struct (lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for texts in batches:
            model = model or (Predictor(net) if net.langs else None)
            yield pd.DataFrame([model.text(t) if model else ("und", 0.0) for t in texts], columns=["lang_pred", "score"])
    return predict


def fold() -> Column:
    """0 to 3, from the id alone; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def identify(docs: DataFrame, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the other folds."""
    batch_limits(docs.sparkSession)
    predict = predictor(fit(docs, fold() != held_out))
    return (docs.select("doc_id", F.coalesce(fold() == held_out, F.lit(False)).alias("held_out"), predict("text").alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def with_language(docs: DataFrame, min_score: float, held_out: int = 2) -> DataFrame:
    """The rows of ``docs``, with all columns, that have a language of at least ``min_score``."""
    batch_limits(docs.sparkSession)
    predict = predictor(fit(docs, fold() != held_out))
    return (docs.withColumn("_llm_p", predict("text"))
            .filter((F.col("_llm_p.lang_pred") != "und") & (F.col("_llm_p.score") >= min_score)).drop("_llm_p"))
