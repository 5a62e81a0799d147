"""Quality by Bradley-Terry ranking of documents.

A document's worth is a weighted sum of its features. The weights make it likely
that, in pairs of a good and a bad labelled document, the good one is preferred:
logistic regression on the difference of their features, without a bias. The
weights are fitted on a bounded sample of labelled rows; the threshold is the
quantile of worth, over all labelled rows, at the share of bad ones among them. A
score of 0.3 lies there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import map_texts, remainder
from quillmark.llm.toxicity import labelled, logistic

#: The score at the threshold.
CUT = 0.3
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"!", b"|", b"?", b".", b",", b"#$%&*", b"+-/<=>@[\\]^_`{}~", b"\"'():;"]
_CLASS = np.full(256, len(_CLASSES))
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_SUM = np.zeros((256, len(_CLASSES) + 1))
_SUM[np.arange(256), _CLASS] = 1


def features(text: str) -> np.ndarray:
    """Shares of character classes, repetition, and lengths; all finite, also for the empty text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _SUM / n
    words, lines = raw.split(), raw.split(b"\n")
    count = max(1, len(words))
    upper = sum(w.isupper() and len(w) > 2 for w in words) / count
    kinds = len(set(words)) / count
    repeated = 1 - len(set(lines)) / len(lines)
    run = sum(a == b for a, b in zip(words, words[1:], strict=False)) / count
    return np.concatenate([shares, np.sqrt(shares), [upper, upper**0.5, kinds, repeated, repeated**0.5, run, run**0.5, math.log1p(len(raw)), math.log1p(count), math.log1p(count) ** 2, math.log1p(n / count), kinds * math.log1p(count)]])


def train(x: np.ndarray, labels: list[int], pairs: int = 20_000, seed: int = 11) -> np.ndarray:
    """Weights from the features of labelled texts (1: good).

    pairs: preference pairs drawn from them. Without texts of both labels
    nothing is preferred: all weights are 0.
    """
    y = np.array(labels)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(len(features("")))
    scale = np.maximum(x.std(axis=0), 1e-6)
    z, rng = x / scale, np.random.default_rng(seed)
    better, worse = z[rng.choice(good, pairs)], z[rng.choice(bad, pairs)]
    flip = np.where(np.arange(pairs) % 2 == 0, 1.0, -1.0)[:, None]
    # The bias of both orders of a pair is 0, so the column for it stays out of the score.
    return logistic(np.hstack([np.ones((pairs, 1)), (better - worse) * flip]), (flip[:, 0] > 0).astype(float), l2=1e-3)[1:] / scale


def worths(df: DataFrame, weights: np.ndarray, text: str, out: str) -> DataFrame:
    apply = lambda texts: [pa.array([float(features(t) @ weights) for t in texts], pa.float64())]
    return map_texts(df, lambda: apply, [T.StructField(out, T.DoubleType())], text)


def quantile(scored: DataFrame, label: str = "label", worth: str = "worth", grid: float = 1e-3) -> float:
    """The worth at the share of label 0 among all rows, to the grid; 0 without rows of both labels.

    Rows are counted by cells of the grid (worth is held to -100 .. 100), so
    what reaches the driver doesn't grow with them.
    """
    cell = F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col(worth))) / grid).cast("long")
    cells = sorted(scored.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("bad")).collect())
    total, bad = sum(r["n"] for r in cells), sum(r["bad"] for r in cells)
    if not 0 < bad < total:
        return 0.0
    below = 0
    for row, following in zip(cells, cells[1:], strict=False):
        below += row["n"]
        if below >= bad:
            return (row["cell"] + following["cell"]) / 2 * grid
    return cells[-1]["cell"] * grid


def score(df: DataFrame, weights: np.ndarray, threshold: float, text: str = "text", out: str = "quality") -> DataFrame:
    """`df` with the quality, 0 to 1, of each whole text; CUT at the threshold.

    A null text is scored as the empty one. Equal texts score alike. All rows
    and columns are kept; a column named as the output is replaced; an empty
    table gives an empty one.
    """
    shift = F.lit(math.log(CUT / (1 - CUT)) - threshold)
    worth = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col(f"`{out}`") + shift))
    return worths(df, weights, text, out).withColumn(out, 1 / (1 + F.exp(-worth)))


def held_out(doc_id):
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = 2500) -> tuple[np.ndarray, float]:
    """Weights and threshold: learnt from up to `rows` documents of either label, of which the driver is
    sent the features; and over all labelled documents that aren't held out, one row an id."""
    sample = labelled(docs, labels, "quality", held_out, rows)
    apply = lambda texts: [pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))]
    made = map_texts(sample, lambda: apply, [T.StructField("x", T.ArrayType(T.DoubleType()))]).select("doc_id", "label", "x").collect()
    made.sort(key=lambda r: r["doc_id"])
    weights = train(np.array([r["x"] for r in made]), [r["label"] for r in made])
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    every = worths(docs.select("doc_id", "text"), weights, "text", "worth").select("doc_id", "worth").join(known, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("worth").alias("worth"))
    return weights, quantile(every)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = 2500) -> DataFrame:
    """Score and prediction for each document; the weights are learnt from up to 2 * `rows` labelled documents that aren't held out, the threshold from all of them."""
    weights, threshold = fitted(docs, labels, rows)
    scored = score(docs.select("doc_id", "text"), weights, threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= CUT).cast("int").alias("predicted"))
