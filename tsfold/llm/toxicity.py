"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and texts without a verdict (U, a mix of
both kinds). With the class prior p, the risk of a classifier g under a loss l
is ``p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])``: the second part is the
risk on clean texts, estimated from U less the toxic share that U holds, and is
kept from going below zero (a step that would push it there is turned round).

Features are the distinct words of a whole text and the beginnings of words,
hashed by numpy from the bytes of a slice of texts. A feature is scaled by how
many standard errors its number of toxic texts lies above what its share of U
lets one expect, and left out below ``NOISE`` of them. A classifier is linear;
an L1 step leaves further weights at zero, so the length of a clean text adds
nothing to its score. ``members`` classifiers are trained in tasks of their own on
disjoint parts of the sample, and their margins are averaged.

Bounds: at most ``max_toxic`` toxic and ``max_unlabelled`` other texts are used
for the fit (those with the smallest hash of their id), and a model has at most
``members * BUCKETS`` weights. All counts of scores cover every row.

Edge cases: null and empty texts have no words and get the score of the bias;
rows are kept as they are (repeated or null ids); without toxic labels every
score is 0; with such labels but no row to learn from (all ids null or held out)
every score is the class prior; other columns are not read. A repeated id takes
its largest label and is learned from by its smallest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, mix, texts_of
from tsfold.llm.units import _M, _M_INV, Texts, _powers

BUCKETS = 1 << 20
#: Lengths in bytes of the beginnings of words that are features beside the whole words.
PREFIXES = (4, 5, 6)
#: Standard errors that chance alone gives some of the features.
NOISE = 3.0
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each word and word beginning in the texts, with repetitions."""
    t = Texts([x.lower().encode() for x in texts])
    n = len(t.buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = _LETTER[t.buf]
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    firsts, lasts = t.starts[t.lens > 0], t.ends[t.lens > 0] - 1
    begin[firsts] = letter[firsts]
    end[lasts] = letter[lasts]
    at, lens = np.flatnonzero(begin), np.flatnonzero(end) + 1 - np.flatnonzero(begin)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((t.buf.astype(np.uint64) + np.uint64(1)) * _powers(_M, n), out=sums[1:])
    inverse = _powers(_M_INV, n)[at]
    doc = np.searchsorted(t.ends, at, side="right")
    docs, features = [], []
    for kind, k in enumerate((None, *PREFIXES)):
        some = slice(None) if k is None else np.flatnonzero(lens > k)
        a, size = at[some], lens[some] if k is None else k
        h = mix((sums[a + size] - sums[a]) * inverse[some] + np.uint64(kind << 56 | (k or 0)))
        features.append((h >> np.uint64(44)).astype(np.int64))
        docs.append(doc[some])
    return np.concatenate(docs), np.concatenate(features)


def distinct_features(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    doc, feature = word_features(texts)
    pairs = np.sort(pd.unique(doc * BUCKETS + feature))
    stops = np.searchsorted(pairs, np.arange(1, len(texts) + 1) * BUCKETS)
    return [x.astype(np.int32) for x in np.split(pairs % BUCKETS, stops[:-1])]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 150, rate: float = 0.1,
        l1: float = 1e-4, min_texts: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with weights other than zero, these weights, and the bias, by full-batch nnPU descent."""
    rows = [*positive, *unlabelled]
    y = np.arange(len(rows)) < len(positive)
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    all_cols = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    used = np.flatnonzero(np.bincount(all_cols, minlength=BUCKETS) >= min_texts)
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    cols, row = place[all_cols], np.repeat(np.arange(len(rows)), lens)
    cols, row = cols[cols >= 0], row[cols >= 0]
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    in_p, in_u = (np.bincount(cols[some[row]], minlength=len(used)) for some in (y, ~y))
    expected = n_p * in_u / n_u
    scale = np.clip(((in_p - expected) / np.sqrt(expected + 1) - NOISE) / 5, 0, 2)
    cols, row = cols[scale[cols] > 0], row[scale[cols] > 0]
    value = scale[cols]
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        g = np.bincount(row, weights=w[cols] * value, minlength=len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        # logistic loss: l(g) = log(1 + exp(-g)), so dl(g) = s - 1 and dl(-g) = s
        clean = np.logaddexp(0, g[~y]).sum() / n_u - prior * np.logaddexp(0, g[y]).sum() / n_p
        up = np.where(y, prior * (s - 1) / n_p, 0)
        down = np.where(y, -prior * s / n_p, s / n_u)
        each = up + down if clean >= 0 else -down
        grad = np.append(np.bincount(cols, weights=each[row] * value, minlength=len(used)), each.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        delta = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-4)
        w -= delta[:-1]
        b -= delta[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * rate / (np.sqrt(v[:-1] / (1 - 0.99 ** step)) + 1e-4))
    kept = np.flatnonzero(w)
    return used[kept], (w * scale)[kept], b


class Model:
    """A linear classifier: the features with weights other than zero, the weights and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scorer(self):
        """A function from texts to scores between 0 and 1."""
        dense = np.zeros(BUCKETS, np.float32)
        dense[self.features] = self.weights

        def score(texts: list[str]) -> np.ndarray:
            doc, feature = word_features(texts)
            has = dense[feature] != 0  # few: only these need to be made distinct
            pairs = pd.unique(doc[has] * BUCKETS + feature[has])
            margin = np.bincount(pairs // BUCKETS, weights=dense[pairs % BUCKETS], minlength=len(texts)) + self.bias
            return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

        return score


def held_out(id_col: Column) -> Column:
    """Rows whose labels are kept for measuring: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = 4000, max_unlabelled: int = 12000, members: int = 2) -> Model:
    """Fit the classifiers on rows that are not held out and average them."""
    spark: SparkSession = docs.sparkSession
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")))
    share = known.agg(F.avg("y")).first()[0]
    if not share:  # nothing toxic to learn from
        return Model(np.zeros(0, np.int64), np.zeros(0), -500.0)
    prior = float(np.clip(share, 1e-4, 0.9))
    ids = docs.select(F.col(id_col).alias("id")).filter("id IS NOT NULL")
    order = [F.xxhash64("id"), F.col("id")]
    p = known.filter("y = 1").join(ids, "id", "left_semi").select("id").orderBy(*order).limit(max_toxic)
    u = ids.filter(~held_out(F.col("id"))).distinct().orderBy(*order).limit(max_unlabelled)
    # at most max_toxic + max_unlabelled ids: bounded whatever the input is
    picked = F.broadcast(p.withColumn("y", F.lit(1)).unionByName(u.withColumn("y", F.lit(0))))
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id")
              .groupBy("id", "y").agg(F.min("text").alias("text")))  # one text of an id, however often it repeats

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rows = distinct_features(texts_of(part, "text"))
                yield pa.record_batch([part.column("id"), part.column("y"), pa.array(rows, pa.list_(pa.int32()))],
                                      names=["id", "y", "features"])

    def member(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "id"])  # the order of rows must not sway the sums
        found, weights, bias = fit(pdf.features[pdf.y == 1].tolist(), pdf.features[pdf.y == 0].tolist(), prior)
        return pd.DataFrame({"found": [found.tolist()], "weights": [weights.tolist()], "bias": [bias]})

    fitted = (sample.mapInArrow(features, "id long, y int, features array<int>")
              .withColumn("member", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(members)))
              .groupBy("member").applyInPandas(member, "found array<long>, weights array<double>, bias double"))
    rows = fitted.collect()  # one row for each member
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    dense = np.zeros(BUCKETS)
    for r in rows:
        np.add.at(dense, np.array(r.found, np.int64), np.array(r.weights) / len(rows))
    kept = np.flatnonzero(dense)
    return Model(kept, dense[kept], float(np.mean([r.bias for r in rows])))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                yield pa.record_batch([part.column("id"), pa.array(scorer(texts_of(part, "text")), pa.float64())],
                                      names=["id", "score"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with a score below ``threshold``; all columns stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part in byte_slices(batch, text_col):
                yield part.filter(pa.array(scorer(texts_of(part, text_col)) < threshold))

    return df.mapInArrow(run, df.schema)
