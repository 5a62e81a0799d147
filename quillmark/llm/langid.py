"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are combined: how likely the text is under each language's
character model; what the markup declares; the host's address suffix; and the
languages of the host's other pages. What they are worth is learnt from the pages
that have text, as labelled by their text alone; pages without text have no vote.
The prior of a page is its host's share of languages, smoothed towards its
domain's, that towards its suffix's, and that towards the whole table's, so the
suffix counts once, as a level of the prior. A page's own vote is left out of its
own prior and of what its markup is worth to it. A declared code that is a
language's name counts for that language as a few pages do, so a declaration tells
something before any page has confirmed it. Counts are grouped aggregations.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import blocks, give_back, map_texts, saved

HIDDEN = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<title\b.*?</title\s*>|<nav\b.*?</nav\s*>")
TAG = re.compile(r"(?s)<[^>]*>")
LETTERS = re.compile(r"[^\W\d_]+")
#: Declared language in the page's first tags.
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def visible(page: str) -> str:
    return entities.unescape(TAG.sub(" ", HIDDEN.sub(" ", page)))


def bigrams(text: str):
    for word in LETTERS.findall(text.lower()):
        yield from pairwise(f" {word} ")


class Model:
    """Log-probabilities of a character given the one before, for each language."""

    def __init__(self, counts: dict[str, Counter], smoothing: float = 0.5):
        self.langs = sorted(counts)
        letters = {b for c in counts.values() for _, b in c}
        self.logs, self.unseen = {}, []
        for i, lang in enumerate(self.langs):
            totals: Counter = Counter()
            for (a, _), n in counts[lang].items():
                totals[a] += n
            size = smoothing * (len(letters) + 1)
            for pair in {p for c in counts.values() for p in c}:
                self.logs.setdefault(pair, [0.0] * len(self.langs))[i] = math.log((counts[lang][pair] + smoothing) / (totals[pair[0]] + size))
        self.blank = [0.0] * len(self.langs)

    def loglikelihoods(self, text: str, temper: float = 0.5) -> list[float]:
        """Of the text in each language, relative to the best; tempered by a fixed factor, as letters aren't independent. Empty if the text has no known pair of letters."""
        sums, known = list(self.blank), False
        for pair, n in Counter(bigrams(text)).items():
            if pair in self.logs:
                known = True
                for i, x in enumerate(self.logs[pair]):
                    sums[i] += n * x
        top = max(sums, default=0.0)
        return [(x - top) * temper for x in sums] if known else []


def sampled(docs: DataFrame, rows: int, broadcast_langs: int = 100_000) -> DataFrame:
    """(lang, text) of about `rows` documents of each language (all, if fewer): those whose ids hash lowest. One row an id, of several the least text.

    Up to `broadcast_langs` languages are broadcast, so that only the sample's texts move; more are joined by a shuffle.
    """
    known = docs.where("lang is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    shares = saved(known.groupBy("lang", "doc_id").agg(F.lit(1).alias("one")).groupBy("lang").agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("share")))
    if shares.count() <= broadcast_langs:
        shares = F.broadcast(shares)
    return known.join(shares, "lang").where(place < F.col("share")).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, rows: int = 300) -> Model:
    """A model from about `rows` documents of each language there is (doc_id, text, lang), whose ids hash lowest.

    The documents' pairs of letters are counted in the executors; what reaches
    the driver is a count for each pair that occurs in a language's sample.
    """

    def run(batches):
        for batch in batches:
            for block in blocks(batch, 1):
                counts: Counter = Counter()
                for lang, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    counts.update((lang, a + b) for a, b in bigrams(text))
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "pair", "n"])
        give_back()

    found: dict[str, Counter] = defaultdict(Counter)
    for lang, pair, n in sampled(docs, rows).mapInArrow(run, "lang string, pair string, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).collect():
        found[lang][pair[0], pair[1]] += n
    return Model(found)


def identify(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html", strength: float = 8.0, trust: float = 4.0) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host) for each row of `pages`.

    confidence: the posterior of lang; text_lang: the likeliest by text alone,
    null for a page without text (or in letters that no language of the model
    has), which the other evidence then decides. strength: pages that each level
    of the priors counts for at the next; trust: pages that a declared code
    counts for by its name. Where several languages are equally likely, as for
    a page without any evidence in a table without any, lang is null. A null
    url has the host "", null markup declares "". Without languages in the
    model, lang and confidence are null. A page's whole markup is read, however
    long. Rows stay, repeated ones too (each votes); other columns aren't read;
    an empty table gives an empty one.
    """
    n = len(model.langs)
    address = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    given = pages.select(F.col(page_id).alias("page_id"), address.alias("host"), F.lower(F.coalesce(F.regexp_extract(F.col(html), DECLARED, 1), F.lit(""))).alias("declared"), F.col(html).alias("html"))
    if not n:
        null = F.lit(None).cast("string")
        return given.select("page_id", null.alias("lang"), F.lit(None).cast("double").alias("confidence"), null.alias("text_lang"), "declared", "host")

    def make():
        return lambda texts: [pa.array([model.loglikelihoods(visible(t)) for t in texts], pa.list_(pa.float64()))]

    rows = map_texts(given, make, [T.StructField("logs", T.ArrayType(T.DoubleType()))], "html").drop("html")
    names, every = F.array(*[F.lit(x) for x in model.langs]), F.sequence(F.lit(0), F.lit(n - 1))
    labels = F.split("host", r"\.")
    # own: the language that the text votes for, by its place in the model; -1 for none.
    own = F.when(F.size("logs") > 0, F.array_position("logs", F.array_max("logs")).cast("int") - 1).otherwise(-1)
    rows = saved(rows.select("*", own.alias("own"), F.element_at(labels, -1).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".").alias("domain")))

    def votes(key: str) -> DataFrame:
        """Votes that the pages of a key have for each language, by its place."""
        each = rows.where("own >= 0").groupBy(key, "own").agg(F.count(F.lit(1)).cast("double").alias("n"))
        return each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("own", "n"))).alias(f"of_{key}"))

    keys = ["suffix", "domain", "host", "declared"]
    full = reduce(lambda df, key: df.join(votes(key), key, "left"), keys, rows)
    total = {r["own"]: float(r["n"]) for r in rows.where("own >= 0").groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()}

    def others(counts: Column) -> Column:
        """Votes for each language, without the page's own."""
        held = F.coalesce(counts, F.create_map().cast("map<int,double>"))
        return F.transform(every, lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0.0)) - F.when(i == F.col("own"), 1.0).otherwise(0.0))

    def smoothed(counts: Column, prior: Column, weight: float = strength) -> Column:
        held = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + weight
        return F.zip_with(counts, prior, lambda x, p: (x + weight * p) / held)

    whole = F.create_map(*[F.lit(x) for i, c in sorted(total.items()) for x in (i, c)]) if total else None
    steps = full.withColumns({"n0": others(whole) if total else F.array_repeat(F.lit(0.0), n), **{f"n_{key}": others(F.col(f"of_{key}")) for key in keys}})
    steps = steps.withColumn("p0", smoothed(F.col("n0"), F.array_repeat(F.lit(1.0 / n), n)))
    for key, above in (("suffix", "p0"), ("domain", "p_suffix"), ("host", "p_domain")):
        steps = steps.withColumn(f"p_{key}", smoothed(F.col(f"n_{key}"), F.col(above)))
    # What a declaration is worth: the share of each language among the pages that declare it, against its share among all.
    named = F.transform(every, lambda i: F.get(F.col("n_declared"), i) + F.when(F.get(names, i) == F.col("declared"), trust).otherwise(0.0))
    steps = steps.withColumn("p_declared", smoothed(named, F.col("p0")))
    logs = F.when(F.size("logs") > 0, F.col("logs")).otherwise(F.array_repeat(F.lit(0.0), n))
    steps = steps.withColumn("sum", F.transform(every, lambda i: F.get(logs, i) + F.log(F.get(F.col("p_host"), i)) + F.log(F.get(F.col("p_declared"), i)) - F.log(F.get(F.col("p0"), i))))
    steps = steps.withColumn("top", F.array_max("sum"))
    weight = F.aggregate(F.transform("sum", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    tied = F.size(F.filter("sum", lambda x: x > F.col("top") - 1e-9)) > 1
    text_lang = F.when(F.col("own") >= 0, F.get(names, F.col("own")))
    return steps.select("page_id", F.when(~tied, F.get(names, F.array_position("sum", F.col("top")).cast("int") - 1)).alias("lang"), F.round(1.0 / weight, 6).alias("confidence"), text_lang.alias("text_lang"), "declared", "host")


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Language of every page; the character models learn from documents of known language."""
    return identify(pages, train(docs))
