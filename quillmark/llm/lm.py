"""Language-model scores by deleted interpolation.

The probability of a token mixes four estimates: every type alike, the share of
the token among all, its share after the token before (a text's start is a
context too), and, for a token that wasn't seen, that something unseen comes.
The mixture's weights depend on how often the context was seen, by powers of
two; a context that was never seen has a bucket of its own. They are learnt by
expectation-maximisation on the part of the training documents whose counts were
left out of the estimates; the scores then use all counts. For learning alone,
left-out tokens are added up by their estimates, rounded to a tenth of a decade:
what is learnt from is then a small table for each bucket at every size of the
input. The scores use the estimates as they are.

Documents are dealt into blocks of some tens of MB. A block counts its words and
its pairs of neighbours and sends, for each range of keys, the sorted keys with
their counts as one packed row. A range sums up what all blocks sent and answers
each with the totals of its keys, in the order of the keys, so that no key is
sent back and no vocabulary is held as a whole anywhere. As each context is
followed by something, a context's total is the count of its word.

A key is 62 bits of a hash. Among 100 million pairs one collision is expected
with a probability of 1e-3; it would add up the counts of two pairs.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import remainder, stored

#: The token at a text's end; no word holds white space.
END = b"\n"
#: Ranges of keys, at least. A packed row then has a sixteenth of a block's keys at most.
RANGES = 16


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


#: The context at a text's start: no word is empty.
START = _hash(b"")


class _Ids(dict):
    """word -> number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """The tokens of a block's texts, and the sorted distinct keys of its words and pairs of neighbours."""

    def __init__(self, texts: pa.ChunkedArray):
        ids = _Ids({END: 0})
        parts, sizes, number = [], [], ids.__getitem__
        for raw in texts:
            tokens = raw.as_py().lower().split()
            tokens.append(END)
            parts.append(np.fromiter(map(number, tokens), np.int32, len(tokens)))
            sizes.append(len(tokens))
        at = np.concatenate(parts)
        del parts
        hashes = np.fromiter(map(_hash, ids), np.uint64, len(ids))
        del ids
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.words, rank = np.unique(hashes >> np.uint64(2), return_inverse=True)
        #: Place in `words` of each token and of the token before; a text's start has the end's, which is as frequent.
        self.word = rank.astype(np.int32)[at]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[self.starts] = rank[0]
        own = hashes[at]
        keys = np.empty_like(own)
        keys[1:] = own[:-1]
        keys[self.starts] = START
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys += own
        del own, at
        for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            keys ^= keys >> np.uint64(33)
            keys *= np.uint64(odd)
        keys ^= keys >> np.uint64(33)
        keys >>= np.uint64(2)
        self.keys = keys

    def at_start(self, tokens: np.ndarray) -> np.ndarray:
        """Whether these tokens (by their places) are the first of their texts."""
        first = np.zeros(len(self.keys), bool)
        first[self.starts] = True
        return first[tokens]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, as compressed planes of bytes."""
    planes = np.stack([c.astype("<u8") for c in columns]).view(np.uint8).reshape(-1, 8).T
    return zstd.compress(planes.tobytes(), 1)


def unpack(raw: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstd.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(columns, -1)


def cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal ranges of 62-bit keys begins among sorted keys, and the end."""
    return np.searchsorted(keys, np.array([(i << 62) // ranges for i in range(ranges + 1)], np.uint64))


def level(count: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A context's bucket: 0 for a text's start, 1 if it wasn't seen, and 2, 3, ... by powers of two of its count."""
    return np.where(start, 0, np.frexp(count.astype(float))[1] + 1)


def ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b) > 0, a.shape))


def estimates(pair: np.ndarray, word: np.ndarray, context: np.ndarray, n: int, types: int) -> list[np.ndarray]:
    """The four estimates from the counts of pairs, of their words and contexts, of all tokens and of all types."""
    return [np.full(len(pair), 1.0 / (types + 1)), ratio(word, n), ratio(pair, context), np.where(word > 0, 0.0, 1.0)]


def told(rows: pa.Table, column: str) -> np.ndarray:
    """A block's totals, the left-in and the left-out ones, in the order of its keys."""
    rows = rows.filter(pc.greater_equal(rows.column("range"), 0)).sort_by("range")
    return np.concatenate([unpack(raw, 2) for raw in rows.column(column).to_pylist()], axis=1).astype(np.int64)


def mixture(rows, rounds: int = 200):
    """Weights of the four estimates by expectation-maximisation. rows: a bucket's left-out counts and estimates."""
    p, n = rows[["p0", "p1", "p2", "p3"]].to_numpy(float), rows["n"].to_numpy(float)
    w = np.full(4, 0.25)
    for _ in range(rounds):
        share = p * w
        share /= share.sum(axis=1, keepdims=True)
        new = (share * n[:, None]).sum(axis=0) + 0.01
        new /= new.sum()
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def count(table: pa.Table, ranges: int) -> pa.Table:
    """What a block sends: keys and counts by ranges, and its left-out pairs by the places of their keys (range -1 - block)."""
    block = Block(table.column("text"))
    kind = np.repeat(table.column("part").to_numpy().astype(np.uint8), block.sizes)
    left = np.flatnonzero(kind == 1)
    of_word = [np.bincount(block.word[kind == k], minlength=len(block.words)) for k in (0, 1)]
    out, first, d = np.unique(block.keys[left], return_index=True, return_counts=True)
    first = left[first]
    sorted_ = block.keys << np.uint64(2) | kind
    del kind
    sorted_.sort()
    kinds = (sorted_ & np.uint64(3)).astype(np.uint8)
    sorted_ >>= np.uint64(2)
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    pairs = sorted_[begin]
    of_pair = [np.add.reduceat(kinds == k, begin, dtype=np.int64) for k in (0, 1)]
    number = table.column("block")[0].as_py()
    rows = [(-1 - number, None, None, pack(np.searchsorted(pairs, out), block.word[first], block.before[first], block.at_start(first), d))]
    at_word, at_pair = cut(block.words, ranges), cut(pairs, ranges)
    for i in range(ranges):
        sent = []
        for keys, (r, d_), at in ((block.words, of_word, at_word), (pairs, of_pair, at_pair)):
            part = slice(at[i], at[i + 1])
            sent.append(pack(np.diff(keys[part], prepend=np.uint64(0)), r[part], d_[part]))
        rows.append((i, *sent, None))
    of_range, words, pairs_, left_ = zip(*rows, strict=True)
    return pa.table({"block": pa.array([number] * len(rows), pa.int32()), "range": pa.array(of_range, pa.int32()), "words": pa.array(words, pa.binary()), "pairs": pa.array(pairs_, pa.binary()), "left": pa.array(left_, pa.binary())})


def answer(sent: pa.Table) -> pa.Table:
    """What a range answers: for each block the totals of its keys. The first row tells of all words: nr, n, vr and v."""
    size = sent.num_rows
    totals = dict.fromkeys(("nr", "n", "vr", "v"), 0)
    columns = {name: sent.column(name) for name in ("words", "pairs")}
    if sent.column("range")[0].as_py() >= 0:
        for name in columns:
            given = [unpack(raw, 3) for raw in columns[name].to_pylist()]
            at = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in given]), return_inverse=True)[1]
            r, d = (np.bincount(at, np.concatenate([g[k] for g in given])).astype(np.int64) for k in (1, 2))
            if name == "words":
                totals = {"nr": r.sum(), "n": (r + d).sum(), "vr": (r > 0).sum(), "v": (r + d > 0).sum()}
            parts = np.split(at, np.cumsum([g.shape[1] for g in given])[:-1])
            columns[name] = pa.array([pack(r[p], d[p]) for p in parts], pa.binary())
    made = {"block": sent.column("block"), "range": sent.column("range"), **columns, "left": sent.column("left")}
    return pa.table(made | {k: pa.array([int(x), *[0] * (size - 1)], pa.int64()) for k, x in totals.items()})


def log_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 32 << 20, left_out: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    held_out: a boolean column of `docs`; such rows are scored, not learnt from
    (null: learnt from). One in `left_out` of the others tunes the weights.
    Tokens are words (A-Z lowered, parted by space and \\t to \\r) and an end. A
    null, empty or blank text is the end alone. base_score: add-one unigram
    log10 probability; score: the model's. Rows stay, repeated ones too (each
    counts); other columns aren't read; an empty table gives an empty one.
    """
    part = F.when(F.coalesce(held_out, F.lit(False)), 2).when(F.pmod(F.xxhash64(F.col(doc_id), F.lit("left out")), F.lit(left_out)) == 0, 1).otherwise(0)
    given = docs.select(F.col(doc_id).alias("doc_id"), part.cast("int").alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = given.where("part < 2").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, size // block_bytes + 1)
    ranges = max(RANGES, number)
    given = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)).cast("int"))

    # Each block and each range is a partition of its own: no task holds more than one, whatever the size of the input.
    by_block = lambda df: df.repartitionById(number, F.col("block")).groupBy("block")
    sent = by_block(given.select("block", "part", "text")).applyInArrow(lambda t: count(t, ranges), "block int, range int, words binary, pairs binary, left binary")
    dealt = sent.withColumn("dealt", F.pmod("range", F.lit(ranges)).cast("int")).repartitionById(ranges, F.col("dealt"))
    answers = stored(dealt.groupBy("dealt", "range").applyInArrow(answer, "block int, range int, words binary, pairs binary, left binary, nr long, n long, vr long, v long"))
    nr, n, vr, v = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("nr", "n", "vr", "v")]).first()

    def coarse(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 10.0 ** np.round(np.log10(np.where(p > 0, p, 1.0)), 1), 0.0)

    def judge_left_out(rows: pa.Table) -> pa.Table:
        import pandas as pd

        pair, word, before, start, d = unpack(rows.filter(pc.less(rows.column("range"), 0)).column("left")[0].as_py(), 5).astype(np.int64)
        of_word, of_pair = told(rows, "words")[0], told(rows, "pairs")[0]
        p0, p1, p2, p3 = estimates(of_pair[pair], of_word[word], of_word[before], nr, vr)
        made = pd.DataFrame({"bucket": level(of_word[before], start > 0).astype(np.int32), "p0": p0, "p1": coarse(p1), "p2": coarse(p2), "p3": p3, "n": d})
        return pa.Table.from_pandas(made.groupby(["bucket", "p0", "p1", "p2", "p3"], as_index=False)["n"].sum(), preserve_index=False)

    left = by_block(answers.select("block", "range", "words", "pairs", "left")).applyInArrow(judge_left_out, "bucket int, p0 double, p1 double, p2 double, p3 double, n long")
    left = left.groupBy("bucket", "p0", "p1", "p2", "p3").agg(F.sum("n").alias("n"))

    def learn(rows):
        import pandas as pd

        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "w": [mixture(rows).tolist()]})

    learnt = {b: w for b, w in left.groupBy("bucket").applyInPandas(learn, "bucket int, w array<double>").collect()}
    # A bucket that nothing was learnt for has the weights of the nearest one.
    weights = np.array([learnt[min(learnt, key=lambda k: (abs(k - b), k))] if learnt else [0.25] * 4 for b in range(66)])

    def add_up(docs_: pa.Table, rows: pa.Table) -> pa.Table:
        block = Block(docs_.column("text"))
        of_word, of_pair = told(rows, "words").sum(axis=0), told(rows, "pairs").sum(axis=0)
        pairs = np.unique(block.keys)
        log_p = np.empty(len(block.keys))
        for i in range(0, len(log_p), 1 << 19):
            part = slice(i, i + (1 << 19))
            pair, word, context = of_pair[np.searchsorted(pairs, block.keys[part])], of_word[block.word[part]], of_word[block.before[part]]
            w = weights[level(context, block.at_start(np.arange(len(log_p))[part]))]
            log_p[part] = np.log10(sum(w[:, k] * p for k, p in enumerate(estimates(pair, word, context, n, v))))
        sizes, count_ = block.sizes, of_word[block.word]
        total = lambda x: np.add.reduceat(x, block.starts)
        return pa.table({
            "doc_id": docs_.column("doc_id"), "held_out": pa.array(docs_.column("part").to_numpy() == 2), "n_tokens": pa.array(sizes), "n_known": pa.array(total((count_ > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(sizes), n, np.int64)), "base_score": pa.array(total(np.log10(count_ + 1.0) - math.log10(n + v + 1))), "score": pa.array(total(log_p)),
        })

    kind = docs.schema[doc_id].dataType.simpleString()
    asked = answers.where("range >= 0").select("block", "range", "words", "pairs")
    return by_block(given).cogroup(by_block(asked)).applyInArrow(add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    return log_scores(docs.select("doc_id", "text"), remainder(F.col("doc_id"), 7) == 2)
