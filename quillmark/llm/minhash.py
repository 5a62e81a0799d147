"""Near-duplicates by MinHash with tensored banding, confirmed on full sets.

A table key of the band index isn't made of hashes of its own: `half` minhashes
make a half-key, there are two collections of `tables` half-keys, and each pair
of one from either collection is a table. So 2 * tables * half minhashes serve
tables ** 2 tables of 2 * half rows each, where separate tables would need
tables ** 2 * 2 * half. Two sets of likeness J miss each other in all tables
with a probability under 2 * (1 - J ** half) ** tables: 5.6e-4 at J = 0.8 and
1e-8 at 0.95, for the defaults.

Copies with equal sets are one class from the start. Candidates are then found
without emitting all pairs of a bucket:

1. every class is compared with one other, the most central class that it meets
   (an original rather than one of its altered copies), and what isn't linked
   then with the most central one among its like; links make components;
2. only buckets that still hold several components are looked at again: members
   outside the bucket's main component against the others, unless the sketches
   (8 bits of each minhash) rule the pair out, or what is known about a common
   head h does. If x and y share no shingle outside h, they share no more than
   the smaller of x & h and y & h, which often is too little;
3. pairs of one head that share a shingle outside it are found by a join on
   that shingle, so the rule of step 2 loses nothing.

A pair at the threshold is ruled out by its sketches with a probability under
1e-4. So pairs within a large group of copies are never formed, and a link between
different texts is only lost with the probabilities above.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import among, blocks, give_back, remember_alone, saved, without
from quillmark.llm.graph import components

#: Words whose hash a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Odd multipliers, drawn once: each minhash has its own.
_SEEDS = np.random.default_rng(20250101).integers(1, 1 << 63, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hash = _WordHash()


def forget() -> None:
    _hash.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text in UTF-8.

    A-Z are lowered; words are what white space (space, \\t to \\r) separates.
    Fewer words than `size` make one shingle; no words make none.
    """
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def minhashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """`count` minhashes of a non-empty set; long sets are done in slices."""
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    seeds = _SEEDS[:count, None]
    for k in range(0, len(hashes), 4096):
        x = hashes[None, k : k + 4096] * seeds
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, x.min(axis=1))
    return mixed(low)


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, half: int, tables: int) -> DataFrame:
    """(doc_id, n_shingles, digest, left, right, sketch) for each row.

    digest: 128 bits of the whole set; left, right: the two collections of
    half-keys; sketch: a byte of each minhash, eight to a long.
    """
    count = 2 * half * tables
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        remember_alone("minhash", forget)
        for batch in batches:
            for block in blocks(batch, 1):
                sizes, digests, sketch = [], [], np.zeros((block.num_rows, count), np.uint8)
                keys = np.zeros((block.num_rows, 2, tables), np.int64)
                for i, raw in enumerate(block.column(1)):
                    found = shingle_set(raw.as_py(), size)
                    sizes.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    if len(found):
                        low = minhashes(found, count)
                        sketch[i] = low.astype(np.uint8)
                        key = np.zeros(2 * tables, np.uint64)
                        for row in low.reshape(half, -1):
                            key = mixed(key * np.uint64(31) + row)
                        keys[i] = key.view(np.int64).reshape(2, tables)

                def lists(values: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))

                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(np.ascontiguousarray(keys[:, 0])), lists(np.ascontiguousarray(keys[:, 1])), lists(sketch.view(np.int64))],
                    names=["doc_id", "n_shingles", "digest", "left", "right", "sketch"],
                )
        give_back()

    return given.mapInArrow(run, "doc_id long, n_shingles long, digest binary, left array<long>, right array<long>, sketch array<long>")


def compared(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(a, b, n_a, n_b, common, added) for each pair (a, b) of ids, from the full sets.

    added: the shingles that a has and b has not, where half of all are common.
    docs: doc_id, text (binary). An id with several texts gives several rows.
    """
    ids = saved(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    texts = among(docs, "doc_id", ids)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        remember_alone("minhash", forget)
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, 2):
                counts, added = [], []
                for ta, tb in zip(block.column(2), block.column(3), strict=True):
                    sets = []
                    for raw in (ta.as_py(), tb.as_py()):
                        if len(known) > 64:
                            known.clear()
                        if (found := known.get(raw)) is None:
                            found = known[raw] = shingle_set(raw, size)
                        sets.append(found)
                    common = np.intersect1d(*sets, assume_unique=True)
                    counts.append((len(sets[0]), len(sets[1]), len(common)))
                    near = 2 * len(common) >= len(sets[0]) + len(sets[1]) - len(common)
                    added.append(np.setdiff1d(sets[0], common, assume_unique=True).view(np.int64) if near else None)
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *columns, pa.array(added, pa.list_(pa.int64()))], names=["a", "b", "n_a", "n_b", "common", "added"])
        give_back()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_a long, n_b long, common long, added array<long>")


def likely(percent: int, common: Column, n_a: Column, n_b: Column) -> Column:
    return (common > 0) & (100 * common >= percent * (n_a + n_b - common))


def headed(buckets: DataFrame) -> DataFrame:
    """(a, b): each id of (key, id, n) with the most central other id that heads a bucket of its own.

    An id is the more central the more others it shares buckets with (n: ids of
    a bucket); the most central id heads a bucket. An original shares more
    buckets with its altered copies than they do among themselves.
    """
    weights = buckets.groupBy("id").agg(F.sum("n").alias("w"))
    ranked = buckets.join(weights, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("head"))
    own = buckets.join(ranked, "key").where(F.col("id") != -F.col("head.i"))
    return own.groupBy("id").agg((-F.max("head")["i"]).alias("b")).select(F.col("id").alias("a"), "b")


def differing(longs: int) -> Column:
    """How many bytes differ between the sketches of x and y, in columns s0, s1, ..."""
    total = F.lit(0)
    for i in range(longs):
        d = F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def packed(keys: str, tables: int, name: str) -> list[Column]:
    """The low halves of an array of half-keys, two to a long, as columns <name>0, <name>1, ..."""
    low = lambda i: F.coalesce(F.get(keys, F.lit(i)), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
    return [low(i).bitwiseOR(F.shiftleft(low(i + 1), 32)).alias(f"{name}{i // 2}") for i in range(0, tables, 2)]


def shared_before(name: str, tables: int) -> Column:
    """Whether x and y have a half-key in common that stands before the bucket's own (x.<name>_before has a bit for each such place).

    Half-keys are compared by 32 bits; a pair is lost if others happen to agree, with a probability under 4e-9.
    """
    equal = F.lit(0).cast("long")
    for i in range(0, tables, 2):
        d = F.col(f"x.{name}{i // 2}").bitwiseXOR(F.col(f"y.{name}{i // 2}"))
        for k, half in ((i, d.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 1, F.shiftrightunsigned(d, 32))):
            equal = equal.bitwiseOR(F.shiftleft(F.shiftrightunsigned(half - 1, 63), k))
    return equal.bitwiseAND(F.col(f"x.{name}_before")) != 0


#: Members of a bucket that one task holds against all others of it.
SHARE = 2000


def faced(members: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """Pairs (x, y) of rows with equal keys for which `where` holds, x among those that aren't inner.

    members: with `inner`, and `n`, the number of rows of its keys. A large
    group is dealt into shares of x, each of which meets all of y on its own, so
    that no task sees a whole large group against itself.
    """
    shares = F.ceil(F.col("n") / SHARE).cast("int")
    x = members.where("not inner").withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).alias("x")
    y = members.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).alias("y")
    alike = reduce(lambda a, b: a & b, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "share"]])
    return x.join(y, alike & (F.col("x.part") != F.col("y.part")) & (F.col("y.inner") | (F.col("x.id") < F.col("y.id"))) & where)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, half: int = 2, tables: int = 8, most_differing: int = 17) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    component_id is the least id that links reach, kept marks the row that is
    it. Ids are whole numbers; one that can't be cast to such counts as none.
    Links join documents whose sets of word shingles have a Jaccard
    likeness of `percent` hundredths or more. A null or empty text, or one of
    white space, is linked with nothing. Repeated rows give a row each and
    belong together; rows of one id with different texts are one document. A
    row without an id is linked with nothing: its component_id is null, and it
    is kept. Other columns aren't read. An empty table gives an empty one.
    most_differing: minhashes that may differ before step 2 passes a pair over.
    """
    longs = 2 * half * tables // 8
    marks = saved(signatures(docs, doc_id, text, size, half, tables))
    full = marks.where("digest is not null and doc_id is not null")
    classes = saved(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("left", "right", "sketch"), "doc_id").alias("keys")))
    # One id with several texts is one document: its classes are linked.
    several = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    own = full.join(several, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    halves = classes.select("rep", F.posexplode("keys.left").alias("i", "l"), F.col("keys.right").alias("right"))
    bands = halves.select("rep", "i", "l", F.posexplode("right").alias("j", "r")).select(F.xxhash64("i", "j", "l", "r").alias("key"), F.col("rep").alias("id"), (F.col("i") * tables + F.col("j")).cast("short").alias("place"))
    filled = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = saved(bands.join(filled, "key"))

    links = own
    rounds = []
    loose = buckets
    for _ in range(2):
        rounds.append(saved(compared(saved(headed(loose)), texts, size)))
        found = rounds[-1].where(likely(percent, F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b")
        links = links.unionByName(found)
        linked = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
        loose = loose.join(linked, "id", "left_anti").select("key", "id", "n")
    links = saved(links.distinct())
    parts = components(links)

    # What is left: pairs that share a bucket but not a component.
    at = buckets.join(parts, "id", "left").select("key", "id", "place", F.coalesce("component", "id").alias("part"))
    mixed_keys = at.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.mode("part", True).alias("main"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "main", "n")
    near = rounds[0].where("added is not null").groupBy("a").agg(F.first("b").alias("head"), F.max("n_a").alias("size"), F.max("common").alias("common")).withColumnRenamed("a", "id")
    # Plain columns, as each pair of a bucket is judged by them first.
    own_sketch = [f"s{i}" for i in range(longs)]
    sketches = classes.select(F.col("rep").alias("id"), *[F.coalesce(F.get("keys.sketch", F.lit(i)), F.lit(0)).alias(c) for i, c in enumerate(own_sketch)], *packed("keys.left", tables, "l"), *packed("keys.right", tables, "r"))
    halves = [f"{side}{i}" for side in "lr" for i in range((tables + 1) // 2)]
    before = [F.expr(f"shiftleft(1L, cast(place {op} {tables} as int)) - 1").alias(f"{side}_before") for side, op in (("l", "div"), ("r", "%"))]
    members = at.join(mixed_keys, "key").join(sketches, "id").join(near, "id", "left").select("key", "n", "id", "part", *before, *halves, *own_sketch, *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("head", "size", "common")], F.col("head").isNotNull().alias("told"), (F.col("part") == F.col("main")).alias("inner"))
    most = F.least(F.col("x.common"), F.col("y.common"))
    settled = F.col("x.told") & F.col("y.told") & (F.col("x.head") == F.col("y.head")) & (100 * most < percent * (F.col("x.size") + F.col("y.size") - most))
    alike = differing(longs) <= most_differing
    met = faced(members, ["key"], ~settled & alike & ~shared_before("l", tables) & ~shared_before("r", tables))

    added = rounds[0].where("added is not null").select(F.col("b").alias("head"), F.col("a").alias("id"), F.explode("added").alias("shingle"))
    added = added.join(parts, "id", "left").select("head", "shingle", "id", F.coalesce("component", "id").alias("part"))
    several_parts = added.groupBy("head", "shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.mode("part", True).alias("main"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("head", "shingle", "main", "n")
    added = added.join(several_parts, ["head", "shingle"]).join(sketches, "id").select("head", "shingle", "n", "id", "part", *own_sketch, (F.col("part") == F.col("main")).alias("inner"))
    sharing = faced(added, ["head", "shingle"], alike)

    pair = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    pairs = met.select(*pair).unionByName(sharing.select(*pair)).distinct()
    done = reduce(DataFrame.unionByName, [r.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for r in rounds])
    pairs = saved(pairs.join(done, ["a", "b"], "left_anti"))
    more = compared(pairs, texts, size).where(likely(percent, F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    parts = components(links.unionByName(more))

    named = classes.select("digest", "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_component"))
    out = marks.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) of which one is left for each group of near-duplicates.

    The one with the least id stays, of repeated rows of an id the one with the
    least text; rows without an id stay.
    """
    found = saved(near_duplicates(docs, **kw).select("doc_id", "kept"))
    rest = without(docs, "doc_id", found.where("not kept").select("doc_id"))
    repeated = saved(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return rest
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    several = among(rest, "doc_id", repeated).groupBy("doc_id").agg(F.min_by(F.struct("text", *others), F.coalesce("text", F.lit(""))).alias("row"))
    single = several.select("doc_id", "row.*").select(*docs.columns)
    return without(rest, "doc_id", repeated).unionByName(single)
