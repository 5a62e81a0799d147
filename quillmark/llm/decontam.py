"""Benchmark decontamination by spaced seeds, on Spark's own functions only.

A mask keeps some positions of a window of tokens and ignores the others. The
hash of the kept tokens, of every window of the benchmark and of the documents,
is the join key, so a window still meets its source if tokens at ignored places
were replaced. Each hit gives an item and its offset in the document. These are told
once each, and for them alone the two token sequences are compared place by place:
the overlap counts if some run of `window` tokens agrees in `percent` hundredths of
its places.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import SPACE, SPACE_CLASS, among, saved, without

#: 1: the token at this place of the window is hashed. All masks are as long. By enumeration these leave no
#: overlap of 8 or more tokens unseen that has 10 of 12 places alike (of fewer than 12 tokens: 80 hundredths).
MASKS = ("11010011", "11101001", "01011101", "10011110")
#: Most seeds that are broadcast (about 40 MB with their items' tokens).
BROADCAST_SEEDS = 200_000


def short_masks(size: int, window: int, percent: int) -> list[str]:
    """Masks for an item of so many tokens, one of which keeps clear of any replacements that the verification lets pass.

    If k may be replaced, the places are parted into k + 2 runs, and each mask leaves out k of them.
    """
    spare = size - math.ceil(min(window, size) * percent / 100)
    runs = min(size, spare + 2)
    run = [place * runs // size for place in range(size)]
    return ["".join("01"[r not in gone] for r in run) for gone in combinations(range(runs), spare)]


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, in order; none for null or blank."""
    bare = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(SPACE))
    return F.when(bare != "", F.transform(F.split(bare, SPACE_CLASS), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>"))


def _at(places: Column, i: Column, offset: int) -> Column:
    return F.get(places, i + F.lit(offset))


def windows(places: Column, masks: list[str]) -> Column:
    """Masked hash of each window, mask after mask; a mask that is too long has none."""

    def of(mask: str) -> Column:
        kept, last = [k for k, c in enumerate(mask) if c == "1"], F.size(places) - len(mask)
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(mask), *[_at(places, i, k) for k in kept]))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<long>"))

    return F.concat(*[of(m) for m in masks])


def window_place(at: Column, size: Column, masks: list[str]) -> tuple[Column, Column]:
    """(first token, mask length) of the at-th entry of `windows` for so many tokens."""
    start, place, length, before = F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int"), []
    for mask in masks:
        end = start + F.greatest(size - (len(mask) - 1), F.lit(0))
        before.append((end, at - start, len(mask)))
        start = end
    for end, first, n in reversed(before):
        place, length = F.when(at < end, first).otherwise(place), F.when(at < end, n).otherwise(length)
    return place.cast("int"), length


def agreement(own: Column, item: Column, offset: Column, window: int, percent: int) -> Column:
    """Most agreeing places of any run of `window` places, if enough, else null.

    The item's place j is held against the document's place j + offset. An item
    shorter than `window` is one run.
    """
    size = F.least(F.lit(window), F.size(item))
    low, high = F.greatest(F.lit(0), -offset), F.least(F.size(item), F.size(own) - offset)
    need = F.ceil(size * percent / 100.0).cast("int")
    same = F.transform(F.sequence(low, high - 1), lambda j: F.when(F.get(item, j) == F.get(own, j + offset), 1).otherwise(0))
    # Folds the places into the current run's agreement and the best so far; `at` holds all places.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("now"), F.lit(0).alias("best"), same.alias("at"))

    def step(held, x):
        gone = F.when(held["n"] >= size, F.get(held["at"], held["n"] - size)).otherwise(0)
        now = held["now"] + x - gone
        return F.struct((held["n"] + 1).alias("n"), now.alias("now"), F.greatest(held["best"], now).alias("best"), held["at"].alias("at"))

    best = F.aggregate(same, start, step, lambda held: held["best"])
    return F.when((high - low >= size) & (size > 0), F.when(best >= need, best))


def overlaps(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, window: int = 12, percent: int = 80, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, start, agreeing, places): each item that a document overlaps.

    start: the document's token at which the item would begin (negative if its
    start is cut off); agreeing of places tokens agree in the best run; of
    several overlaps the best and first is told. Items with fewer tokens than a
    mask are looked for by masks of their length, so an item of one word is in
    every text with that word. Null, empty and blank texts overlap with nothing;
    texts of any length are read as a whole. Rows of one id, or without one, are
    one document, and likewise for items. Other columns aren't read. Empty
    tables give an empty one. The seeds of a small benchmark are broadcast; a
    larger one's are joined by a shuffle.
    """
    span = len(masks[0])
    items = bench.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item")).distinct().where(F.size("item") > 0)
    short = sorted(r[0] for r in items.select(F.size("item").alias("n")).where(F.col("n") < span).distinct().collect())
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    every = [*masks, *(m for n in short for m in short_masks(n, window, percent))]

    def seeded(df: DataFrame, column: str, at: str, keep: list[str]) -> DataFrame:
        """A row for each window. The outer form adds no filter on the hashes' number, which would compute them anew."""
        made = df.select(*keep, F.size(column).alias("size"), windows(F.col(column), every).alias("hashes")).select(*keep, "size", F.posexplode_outer("hashes").alias("at", "seed"))
        place, length = window_place(F.col("at"), F.col("size"), every)
        return made.select(*keep, "size", "seed", place.alias(at), length.alias("length"))

    # An item is looked for by the masks or, if it is too short for them, by masks of its own length.
    seeds = seeded(items, "item", "item_at", ["item_id"]).where(F.col("length") == F.least(F.lit(span), F.col("size"))).select("item_id", "seed", "item_at")
    if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        seeds = F.broadcast(seeds)
    asked = seeded(texts.select("doc_id", tokens(F.col("text")).alias("own")), "own", "doc_at", ["doc_id"]).select("doc_id", "seed", "doc_at")
    met = saved(asked.join(seeds, "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("offset")).distinct())
    own = among(texts, "doc_id", met.select("doc_id").distinct(), null_safe=True).select("doc_id", tokens(F.col("text")).alias("own"))
    hits = met.join(items, met["item_id"].eqNullSafe(items["item_id"])).select("doc_id", met["item_id"], "offset", "item")
    both = hits.join(own, hits["doc_id"].eqNullSafe(own["doc_id"])).select(hits["doc_id"], "item_id", "offset", "item", "own")
    told = both.select("doc_id", "item_id", "offset", F.least(F.lit(window), F.size("item")).alias("places"), agreement(F.col("own"), F.col("item"), F.col("offset"), window, percent).alias("agreeing"))
    best = F.max(F.when(F.col("agreeing").isNotNull(), F.struct("agreeing", (-F.col("offset")).alias("before"), "places")))
    return told.groupBy("doc_id", "item_id").agg(best.alias("best")).where("best is not null").select("doc_id", "item_id", (-F.col("best.before")).alias("start"), "best.agreeing", "best.places")


def clean(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) that overlap no item; see `overlaps`."""
    return without(docs, "doc_id", overlaps(docs, bench, **kw).select("doc_id"))


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Each contaminated document with the item it overlaps."""
    return overlaps(docs, bench)
