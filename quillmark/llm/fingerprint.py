"""Threshold-scaled fingerprints, on Spark's own functions only.

A document's shingle hashes that lie under a fixed fraction of the hash range
are its fingerprint. What two documents share under the threshold estimates what
they share at all, whatever their sizes, and the fingerprint of joined documents
is the union of theirs. Texts with few shingles would often have none under the
threshold; their least hash is kept instead. It lies above the threshold, which
tells it apart, and stands for a likeness only: containment and merging, which
rest on the threshold, leave it out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import SPACE, SPACE_CLASS

#: One hash in so many is kept.
SCALE = 8
SIZE = 5
#: Most range ends (a long each) that are broadcast.
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, in order; none for null or blank."""
    bare = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(SPACE))
    return F.when(bare != "", F.transform(F.split(bare, SPACE_CLASS), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>"))


def threshold(scale: int) -> Column:
    return F.lit(-(1 << 63) + ((1 << 64) // scale))


def sketched(df: DataFrame, texts: dict[str, str], size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """`df` with the fingerprint, named by the value, of each text column, the key of `texts`.

    Each step is a projection of its own: an expression that the next one uses
    more than once is then computed once.
    """
    low = threshold(scale)
    made = {text: (f"__words_{i}", f"__shingles_{i}", f"__kept_{i}") for i, text in enumerate(texts)}
    out = df.withColumns({w: word_hashes(F.col(f"`{t}`")) for t, (w, _, _) in made.items()})

    def shingles(words: str) -> Column:
        # Beyond the last word F.get gives null, which the hash passes over: fewer words than `size` make one shingle.
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)]))

    out = out.withColumns({s: shingles(w) for w, s, _ in made.values()})
    out = out.withColumns({k: F.filter(s, lambda h: h < low) for _, s, k in made.values()})
    none = F.array().cast("array<long>")
    out = out.withColumns({texts[t]: F.when(F.size(w) == 0, none).when(F.size(k) == 0, F.array(F.array_min(s))).otherwise(F.array_sort(F.array_distinct(k))) for t, (w, s, k) in made.items()})
    return out.drop(*[c for names in made.values() for c in names])


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a, null if none of a's hashes is under the threshold, as nothing is known then."""
    under = F.filter(a, lambda h: h < threshold(scale))
    return F.when(F.size(a) == 0, 1.0).when(F.size(under) > 0, F.size(F.array_intersect(under, b)) / F.size(under))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness; 1 for two empty fingerprints."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, 1.0).otherwise(common / either)


def written(kept: Column) -> Column:
    """A fingerprint as text: hexadecimal hashes, by commas."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.hex(h))), ",")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """`df` with the fingerprint (array of longs) of every whole text.

    Null, empty and blank texts have an empty one; equal texts equal ones. All
    rows and columns are kept; a column named as the output is replaced.
    """
    return sketched(df, {text: out}, size, scale)


def merged(df: DataFrame, keys: list[str], column: str = "fingerprint", scale: int = SCALE) -> DataFrame:
    """The fingerprint of all documents of a key together: the union of theirs under the threshold or, if there is none, the least hash of all."""
    one = df.select(*keys, F.explode(column).alias("h")).distinct()
    under = F.collect_list(F.when(F.col("h") < threshold(scale), F.col("h")))
    return one.groupBy(*keys).agg(F.when(F.size(under) == 0, F.array(F.min("h"))).otherwise(F.array_sort(under)).alias(column))


def ranged(docs: DataFrame, columns: list[str], per_bucket: int, bands: int) -> Column:
    """Column: the range of a row's doc_id, in ascending order of ids, negative for rows without one.

    Ids are cut at their approximate quantiles into up to `bands` bands of like
    numbers of rows, and each band into ranges of equal width, of about
    `per_bucket` rows; so an id far from all others widens the ranges of its own
    band alone. Rows without an id are dealt into ranges by a hash.
    """
    n, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    parts = max(1, min(bands, known // (per_bucket * 16)))
    number = F.col("doc_id").cast("double")
    cuts = sorted(set(docs.select(number.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 1e-4))) if parts > 1 else []
    # Cuts in rows of `step`: a row's band is found by two short searches.
    step = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def below(values: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in values]), lambda x: x <= number)) if values else F.lit(0)

    row = below([r[0] for r in rows[1:]])
    held = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows]) if rows else None
    band = (row * step + F.size(F.filter(F.get(held, row), lambda x: x <= number)) if rows else F.lit(0)).cast("long")
    spans = docs.where("doc_id is not null").groupBy(band.alias("band")).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    low, width = [0.0] * (len(cuts) + 1), [1.0] * (len(cuts) + 1)
    for r in spans:
        low[r["band"]] = r["lo"]
        width[r["band"]] = max((r["hi"] - r["lo"] + 1.0) * per_bucket / r["n"], 1.0)
    at = lambda values: F.get(F.array(*[F.lit(x) for x in values]), band.cast("int"))
    cell = F.floor((number - at(low)) / at(width)).cast("long")
    return F.coalesce(band * (1 << 40) + cell, -1 - F.shiftrightunsigned(F.xxhash64(*columns), 54))


def with_next(docs: DataFrame, columns: list[str], per_bucket: int = 64, per_group: int = 4096, bands: int = 1024) -> DataFrame:
    """`docs` (doc_id and `columns`) with next_<column> of the next row by descending doc_id; after the last comes the first.

    Ids are cut into ranges of about `per_bucket` rows (see `ranged`). A row's
    next is in its range, but for the last of each, to which the first of the
    next range is copied. So every row is moved once and no task sees all rows;
    only the ranges' ends, one row for `per_bucket`, are looked at by groups,
    and the groups' ends together. Rows of one id follow one another in the
    order of `columns`; rows without an id come last, in an order of their own
    that depends on their columns alone. A single row is its own next.
    """
    given = docs.select("doc_id", *columns, ranged(docs, columns, per_bucket, bands).alias("bucket"))
    # Which range comes before each one: within groups of neighbouring ranges (by rank in their band of ids), then from group to group.
    counted = given.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    ranges = counted.withColumn("band", F.floor(F.col("bucket") / per_group))
    ends = ranges.groupBy("band").agg(F.min("bucket").alias("last"))
    ends = ends.select("band", F.lag("last").over(Window.orderBy(F.desc("band"))).alias("above"), F.min("last").over(Window.partitionBy()).alias("final"))
    before = F.lag("bucket").over(Window.partitionBy("band").orderBy(F.desc("bucket")))
    lenders = ranges.withColumn("same", before).join(ends, "band").select("bucket", "doc_id", F.coalesce("same", "above", "final").alias("to"))
    # The first row of each range is lent to the range before it, where it comes last.
    if docs.count() // per_bucket <= BROADCAST_ROWS:
        lenders = F.broadcast(lenders)
    heads = given.join(lenders, (given["bucket"] == lenders["bucket"]) & given["doc_id"].eqNullSafe(lenders["doc_id"])).groupBy(lenders["to"].alias("bucket"), given["doc_id"])
    lent = heads.agg(F.min(F.struct(*columns)).alias("row")).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in columns], "bucket", F.lit(True).alias("lent"))
    every = given.select("doc_id", *columns, "bucket", F.lit(False).alias("lent")).unionByName(lent)
    ordered = Window.partitionBy("bucket").orderBy("lent", F.desc_nulls_last("doc_id"), *columns)
    return every.select("lent", "doc_id", *columns, *[F.lead(c).over(ordered).alias(f"next_{c}") for c in columns]).where("not lent").drop("lent")


def edited(text: Column, following: Column) -> Column:
    """`text` with its second half (rounded down) replaced by as many characters of the following text, or all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, their likeness to one another and to the next document's,
    and the share of the text's shingles that either contains (null where the fingerprint tells nothing of it)."""
    texts = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), ["text"])
    changed = texts.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    made = sketched(changed, {"text": "own", "edited": "other", "next_text": "next"})
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        F.round(likeness(F.col("own"), F.col("other")), 6).alias("near_edited"), F.round(likeness(F.col("own"), F.col("next")), 6).alias("near_next"),
        F.round(containment(F.col("own"), F.col("other")), 6).alias("in_edited"), F.round(containment(F.col("own"), F.col("next")), 6).alias("in_next"),
    )
