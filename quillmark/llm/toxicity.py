"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on ordinary and one on toxic
labelled text. Either holds the windows that its own texts use most, and nearest
to the window those that tell it from the other: for the ordinary one, windows
that would else be mistaken; for the toxic one, those that its texts have far
more often. How many bytes shorter a window compresses under the toxic
dictionary than under the ordinary one tells how much of it only toxic text
explains. The gain from which a window counts is calibrated on the windows of
ordinary labelled texts, and a document's score, a logistic function of its
windows' gains, on the labelled rows.

A window is a distinct word of a text: where words aren't parted by spaces
(Chinese, Japanese, Thai, Lao, Khmer, Burmese), each two and each four letters on
end; and of a run of more than PIECE letters, pieces that overlap by half. So every letter of
a text is in some window. Inside windows and dictionaries each byte is followed by
its place in the window, so that a match starts where the window does, and a
fixed mark precedes a window, so that every frame has a compressed block and
lengths compare.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import give_back, map_texts, remainder, remember_alone

#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, Kana, and Han.
_JOINED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
RUNS = re.compile(rf"([{_JOINED}]+)|[^\W\d_{_JOINED}]+")
#: Letters of a piece of a long run (128 bytes at most), and of the windows of joined script.
PIECE, JOINED = 32, (2, 4)
MARK = b"~{^}~{^}" * 3
_PLACES = bytes(range(128, 256))
#: Differences that a worker remembers before it starts afresh.
REMEMBERED = 400_000


def pieces(run: str, size: int, step: int) -> list[str]:
    return [run[i : i + size] for i in range(0, max(1, len(run) - size + step), step)]


def windows(text: str) -> set[str]:
    """The distinct windows of a whole text."""
    found: set[str] = set()
    for m in RUNS.finditer(text.lower()):
        run = m.group()
        if m.group(1):
            for size in JOINED:
                found.update(pieces(run, size, 1))
        elif len(run) <= PIECE:
            found.add(run)
        else:
            found.update(pieces(run, PIECE, PIECE // 2))
    return found


def placed(window: str) -> bytes:
    """The window in UTF-8, each byte followed by its place."""
    raw = window.encode("utf-8", "replace")
    out = bytearray(2 * len(raw))
    out[::2], out[1::2] = raw, _PLACES[: len(raw)]
    return bytes(out)


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
        strategy=zstd.STRATEGY_BTOPT, min_match=3, window_log=20, hash_log=17, chain_log=17, search_log=6, target_length=64,
    )
    made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=made, compression_params=params)


@dataclass
class Model:
    """The dictionaries' contents, the gain from which a window counts, and the calibrated weights of `features`."""

    ordinary: bytes
    toxic: bytes
    least: int = 3
    weights: list[float] = field(default_factory=list)


def features(gains: np.ndarray, least: int) -> list[float]:
    """Bias, the two largest gains, how many windows gain enough (by the root of all, by all), log of all."""
    n = max(len(gains), 1)
    top = np.sort(gains)[-2:][::-1].tolist() + [0, 0]
    hits = int((gains >= least).sum())
    return [1.0, max(top[0], 0), max(top[1], 0), hits / math.sqrt(n), hits / n, math.log1p(n)]


class Judge:
    """Compares window lengths under a model's two dictionaries."""

    def __init__(self, model: Model):
        self.weights, self.least = np.array(model.weights), model.least
        self.ordinary, self.toxic = _compressor(model.ordinary + MARK), _compressor(model.toxic + MARK)
        self.known: dict[str, int] = {}

    def gain(self, window: str) -> int:
        """Bytes that the toxic dictionary saves on a window, against the ordinary one."""
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            raw = MARK + placed(window)
            found = self.known[window] = len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw))
        return found

    def features(self, own: set[str]) -> list[float]:
        return features(np.fromiter(map(self.gain, own), np.int64, len(own)), self.least)

    def score(self, text: str) -> float:
        x = float(np.dot(self.features(windows(text)), self.weights))
        return 1 / (1 + math.exp(-min(max(x, -40.0), 40.0)))


@lru_cache(maxsize=2)
def _judge(ordinary: bytes, toxic: bytes, least: int, weights: tuple[float, ...]) -> Judge:
    return Judge(Model(ordinary, toxic, least, list(weights)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; column 0 is the bias."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0], shift = 1.0, x.mean(axis=0)
    shift[0] = 0.0
    z, w = (x - shift) / scale, np.zeros(x.shape[1])
    ridge = np.full(len(w), l2 * len(y))
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    w = w / scale
    w[0] -= float(shift @ w)
    return w


def train(sets: list[set[str]], labels: list[int], **kw) -> Model:
    """A model of the windows of labelled texts (1: toxic). See `trained`."""
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for own in sets for w in sorted(own)]
    return trained(list(number), np.array(ids, np.int64), np.array([len(own) for own in sets], np.int64), np.array(labels), **kw)


def trained(known: list[str], ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, least: int = 3, ratio: float = 20.0, size: int = 6000, rounds: int = 2, mistaken_share: float = 1e-3) -> Model:
    """A model of labelled texts (1: toxic).

    known: the distinct windows of all texts; ids, sizes: those of one text after
    another, by their places in it, and how many each text has.
    least, ratio: what tells toxic text is in so many toxic texts (and in a
    hundredth of them), and so many times more often than in ordinary ones.
    size: windows of the ordinary dictionary, to which each of `rounds` adds as
    many mistaken ones at most; the toxic one holds a fifth of that.
    mistaken_share: of ordinary windows, that may gain what counts. Without
    texts of both labels the score is the share of toxic ones, smoothed.
    """
    y = labels.astype(float)
    n_bad, n_good = int(y.sum()), len(y) - int(y.sum())
    if not n_bad or not n_good:
        share = (n_bad + 0.5) / (len(y) + 1)
        return Model(b"", b"", weights=[math.log(share / (1 - share)), 0, 0, 0, 0, 0])
    of_toxic = np.repeat(labels == 1, sizes)
    bad, good = (np.bincount(ids[mask], minlength=len(known)) for mask in (of_toxic, ~of_toxic))
    odds = (bad / n_bad) / ((good + 0.5) / n_good)
    least = max(least, math.ceil(n_bad / 100))

    def most(counts: np.ndarray, n: int) -> list[int]:
        """The n most frequent windows, from rare to frequent: nearest to the window stands what comes last."""
        return sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], known[i]))[:n][::-1]

    content = lambda places: b"".join(placed(known[i]) for i in places)
    telling = sorted(np.flatnonzero((bad >= least) & (odds >= ratio)).tolist(), key=lambda i: (bad[i], known[i]))
    toxic = content([*(i for i in most(bad, size // 5) if odds[i] < ratio), *telling])
    usual, mistaken = most(good, size), np.zeros(len(known), np.int64)
    for k in range(rounds + 1):
        judge = Judge(Model(content(most(mistaken, size) + usual), toxic))
        gains = np.fromiter(map(judge.gain, known), np.int64, len(known))
        if k < rounds:
            mistaken += np.where((gains >= 3) & (odds < 4), good, 0)
    order = np.argsort(-gains, kind="stable")
    passed = np.cumsum(good[order]) <= mistaken_share * good.sum()
    # The least gain from 2 on that no more than the share of ordinary windows reaches.
    judge.least = max(2, int(gains[order][~passed].max(initial=0)) + 1)
    x = np.array([features(gains[own], judge.least) for own in np.split(ids, np.cumsum(sizes)[:-1])])
    return Model(content(most(mistaken, size) + usual), toxic, judge.least, logistic(x, y).tolist())


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int) -> DataFrame:
    """(doc_id, label, text) of up to `rows` documents of either label, whose ids hash lowest; rows for which `held_out` holds are left out.

    One row an id, however often it occurs: the least label and the least text. A null text is empty.
    """
    ids = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"))
    picked = [ids.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for value in (0, 1)]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`df` with the toxicity, 0 to 1, of each whole text.

    A null text is scored as the empty one, a text without words by the bias
    alone. Equal texts score alike. All rows and columns are kept; a column
    named as the output is replaced; an empty table gives an empty one.
    """
    key = (model.ordinary, model.toxic, model.least, tuple(model.weights))

    def make():
        remember_alone("toxicity", _judge.cache_clear)
        judge = _judge(*key)
        return lambda texts: [pa.array([judge.score(t) for t in texts], pa.float64())]

    return map_texts(df, make, [T.StructField(out, T.DoubleType())], text)


def held_out(doc_id):
    return F.coalesce(remainder(doc_id, 3) == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = 2500) -> Model:
    """A model of up to `rows` documents of either label; their distinct windows are what the driver is sent."""
    found = labelled(docs, labels, "toxic", held_out, rows)
    apply = lambda texts: [pa.array([sorted(windows(t)) for t in texts], pa.list_(pa.string()))]
    made = map_texts(found, lambda: apply, [T.StructField("windows", T.ArrayType(T.StringType()))]).select("doc_id", "label", "windows").toArrow().sort_by("doc_id")
    if not made.num_rows:
        return train([], [])
    lists = made.column("windows").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    model = trained(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64), made.column("label").to_numpy())
    del made, lists, coded
    give_back()
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = 2500, least: float = 0.7) -> DataFrame:
    """Score and prediction for each document; learnt from up to 2 * `rows` labelled documents that aren't held out."""
    scored = score(docs.select("doc_id", "text"), fitted(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= least).cast("int").alias("predicted"))
