"""Secret scans: patterns, and Markov models of random and ordinary strings.

Three patterns give the base spans. Beside them, every longer run of key-like
characters is judged by two first-order character models, one of random strings
and one of ordinary identifiers: a run whose log-likelihood ratio reaches a
threshold is a span of kind `markov`, unless a base span covers it. The models
are transition counts over labelled samples with additive smoothing: strings of
the documents, the names that Python's own library defines, compound names, paths
and dates made of their words, and keys drawn from usual alphabets. A part of
the names and keys is held out, and the threshold is the least ratio that outweighs
the odds before and that no more than a thousandth of the held-out ordinary
strings reaches.
"""

from __future__ import annotations

import importlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import blocks, fresh, give_back, map_texts, remember_alone

KINDS = ("assign", "access", "hex", "markov")
_ORDER = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: One of these is in the lower-cased text wherever ASSIGN can match.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Runs that the models judge: no letter or digit of any script may adjoin them.
RUN = re.compile(r"(?<!\w)[A-Za-z0-9+/_=-]{16,}+(?!\w)")
IDENTIFIER = re.compile(r"(?<!\w)[A-Za-z0-9+/_=-]{6,}+(?!\w)")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: State 0 is a string's start.
_STATE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_CODES = np.zeros(128, np.int64)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
STATES = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, unordered; offsets in code points."""
    found, lowered = [], text.lower()
    if any(w in lowered for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def states(value: str) -> np.ndarray:
    return np.concatenate([[0], _CODES[np.frombuffer(value.encode("ascii"), np.uint8)]])


#: Modules whose names are labelled ordinary.
MODULES = "argparse ast asyncio calendar collections configparser csv datetime decimal email.message functools http.client http.server inspect json logging logging.handlers multiprocessing os pathlib pickle random shutil socket sqlite3 ssl statistics string subprocess tarfile tempfile textwrap threading tokenize traceback types typing unittest unittest.mock urllib.parse urllib.request uuid xml.dom.minidom xml.etree.ElementTree xml.sax.handler zipfile".split()


@lru_cache(maxsize=1)
def library_names() -> list[str]:
    """Names that Python's library defines: of modules, and of what is in them and in their classes."""
    found: set[str] = set()
    for name in MODULES:
        module = importlib.import_module(name)
        found.add(name.replace(".", "/"))
        for own in dir(module):
            found.add(own)
            value = getattr(module, own)
            if isinstance(value, type):
                found.update(dir(value))
    return sorted(n for n in found if n.isascii() and not n.startswith("__"))


def made_up(count: int = 12000, seed: int = 7) -> list[tuple[str, bool]]:
    """Labelled strings: keys drawn from usual alphabets; library names, and names, paths, dates, numbers and UUIDs made beside them."""
    rng = random.Random(seed)
    letters = ALPHABET[:62]
    alphabets = [letters, letters + "_-", letters + "+/", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", letters[26:], letters[:26] + letters[52:]]
    keys = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 48))) for _ in range(count // 2)]
    own = library_names()
    words = sorted({w.lower() for n in own for w in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])", n)})
    numbers = lambda: "-".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(2, 4)))
    uuid = lambda: "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12))
    date = lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    styles = [
        "_".join, "-".join, "/".join, lambda p: "_".join(p).upper(), lambda p: p[0] + "".join(x.title() for x in p[1:]), lambda p: "".join(x.title() for x in p),
        lambda p: "/".join(p[:-1]) + "/" + p[-1].title() + "File", lambda p: f"{date()}-{'-'.join(p)}", lambda p: f"{'_'.join(p)}_{rng.randint(0, 99)}", lambda p: f"{'-'.join(p)}-v{rng.randint(1, 9)}", lambda p: numbers(), lambda p: str(rng.randrange(10**20)), lambda p: uuid(), lambda p: "".join(p),
    ]
    names = [rng.choice(styles)(rng.choices(words, k=rng.randint(2, 7))) for _ in range(count // 2)]
    return [(k, True) for k in keys] + [(n, False) for n in names + own]


def labelled(texts: list[str]) -> Counter:
    """Transition counts (label, from, to) of the runs in texts: values that a pattern finds are keys, the rest identifiers."""
    counts: Counter = Counter()
    for text in texts:
        spans = base_spans(text)
        for start, end, kind in spans:
            if kind != "assign":
                counts.update(_steps(text[start:end], True))
        for m in IDENTIFIER.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e, _ in spans):
                counts.update(_steps(m.group(), False))
    return counts


def _steps(value: str, label: bool) -> list[tuple[bool, int, int]]:
    at = [0, *[_STATE[c] for c in value if c in _STATE]]
    return [(label, a, b) for a, b in zip(at, at[1:], strict=False)]


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """The text of the `rows` documents whose ids hash lowest (all, if fewer): a fixed sample, whatever the partitioning."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")


@dataclass
class Model:
    """Log-likelihood ratio (random over ordinary) of each transition, the ratio from which a run is a secret, and the share of held-out keys that reach it."""

    ratios: np.ndarray
    least: float
    recall: float

    def score(self, run: str) -> float:
        at = states(run)
        return float(self.ratios[at[:-1], at[1:]].sum())


def train(samples: DataFrame, smoothing: float = 0.5, made: int = 12000, mistaken: float = 1e-3, odds: float = 1e-3) -> Model:
    """A model of the strings that a table's text column has (`labelled`), and of `made` generated ones and library names.

    A quarter of the latter, by their order when shuffled, is held out; of those
    with 16 characters or more, `mistaken` of the ordinary ones at most reach the
    threshold, which is no less than what outweighs `odds`, those of a run being a
    key before it is looked at. What reaches the driver is a count for each of 2 * 68 * 68
    transitions at most. Empty samples leave the generated strings.
    """

    def run(batches):
        remember_alone("secrets", lambda: None)
        for batch in batches:
            for block in blocks(batch, 0):
                counts = labelled([x or "" for x in block.column(0).to_pylist()])
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), *[pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)], pa.array([counts[k] for k in keys], pa.int64())], names=["label", "a", "b", "n"])
        give_back()

    rows = samples.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "label boolean, a int, b int, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect()
    drawn = made_up(made)
    random.Random(11).shuffle(drawn)
    held, learnt = drawn[: len(drawn) // 4], drawn[len(drawn) // 4 :]
    own = np.zeros((2, STATES, STATES))
    for value, label in learnt:
        np.add.at(own[int(label)], (states(value)[:-1], states(value)[1:]), 1)
    of_docs = np.zeros((2, STATES, STATES))
    for label, a, b, n in rows:
        of_docs[int(label), a, b] += n
    # The documents' strings count as much as the generated ones at most, so that one corpus' prose can't drown the names.
    for k in (0, 1):
        own[k] += of_docs[k] * min(1.0, own[k].sum() / max(of_docs[k].sum(), 1.0))
    own += smoothing
    logs = np.log(own / own.sum(axis=2, keepdims=True))
    model = Model(logs[1] - logs[0], 0.0, 0.0)
    scores = {kind: sorted(model.score(v) for v, label in held if label == kind and len(v) >= 16) for kind in (False, True)}
    ordinary = scores[False]
    # The ratio next above that of the first ordinary string that is let pass.
    model.least = max(-math.log(odds), ordinary[max(0, len(ordinary) - 1 - int(mistaken * len(ordinary)))] + 1e-9) if ordinary else -math.log(odds)
    model.recall = sum(x >= model.least for x in scores[True]) / max(len(scores[True]), 1)
    return model


def spans(text: str, model: Model) -> list[tuple]:
    """(start, end, kind, score) of each span of a text, in order of start, then of kind as in KINDS."""
    found = [(s, e, k, None) for s, e, k in base_spans(text)]
    for m in RUN.finditer(text):
        if not any(s <= m.start() and m.end() <= e for s, e, _, _ in found):
            score = model.score(m.group())
            if score >= model.least:
                found.append((m.start(), m.end(), "markov", score))
    return sorted(found, key=lambda x: (x[0], _ORDER[x[2]]))


def find(df: DataFrame, model: Model, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """`df` with an array of the spans (kind, start, end, score) of each whole text.

    Spans are in order of start, then of kind as in KINDS; offsets count code
    points, the end is exclusive; score is the log-likelihood ratio of a
    `markov` span, else null. A null or empty text has no spans (an empty
    array); a text of any length is read as a whole; equal texts have equal
    spans. All rows and columns are kept; a column named as the output is
    replaced; an empty table gives an empty one.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def apply(texts: list[str]) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in spans(t, model)] for t in texts], kind)]

    schema = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    return map_texts(df, lambda: apply, [T.StructField(out, schema)], text)


def hidden(text: str, found: list[tuple], mark: str) -> str:
    """`text` with each span, or overlapping spans together, replaced by `mark`."""
    parts, at = [], 0
    for start, end, *_ in found:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, model: Model, text: str = "text", out: str = "redacted_text", mark: str = "[SECRET]", changed: str | None = None) -> DataFrame:
    """`df` with each whole text, its secrets replaced by `mark`; null for null, the text itself if it has none. Otherwise as `find`.

    changed: the name of a column that tells whether a text is another than before, if one is wanted.
    """
    told = fresh(df, "__told")
    outputs = [T.StructField(out, T.StringType()), *([T.StructField(changed, T.BooleanType())] if changed else [])]

    def apply(texts: list[str]) -> list[pa.Array]:
        made = [hidden(t, spans(t, model), mark) for t in texts]
        return [pa.array(made, pa.string()), *([pa.array([a != b for a, b in zip(made, texts, strict=True)], pa.bool_())] if changed else [])]

    def make():
        remember_alone("secrets", lambda: None)
        return apply

    made = map_texts(df.withColumn(told, F.col(f"`{text}`").cast("string").isNotNull()), make, outputs, text)
    return made.withColumn(out, F.when(F.col(told), F.col(out))).drop(told)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_digests(docs: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """Counts and digests of the spans of each document; the models learn from `sample_rows` documents."""
    found = find(docs.select("doc_id", "text"), train(sampled(docs, sample_rows)))
    every = F.col("secret_spans")
    base = F.filter(every, lambda s: s["kind"] != "markov")
    return found.select("doc_id", *[of_kind(every, k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"), of_kind(every, "markov").alias("n_markov"))
