"""License scans by canonical digests, on Spark's own functions only.

A text is brought to a canonical form: lower case, equivalent spellings and the
holders' names made one, copyright lines and punctuation gone, white space
single. Digests of known licences are looked up by a hash join. Notices, of
one line or paragraph, are looked for among the lines and paragraphs of a text;
full texts anywhere in it, whatever their paragraphs: wherever the first letters
of a known text stand, what follows is cut to its size, and the digest compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.license_digests import FULL

#: One of these is in every known licence, lower-cased; texts without any aren't looked at further.
WORDS = ("licens", "licenc", "permission", "redistribution", "unencumbered")
#: Licence notices as their licensors word them. Full texts are known by the digests in `FULL`.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

#: Pattern and replacement, in this order, after lower-casing. The patterns mean the same to Java's and RE2's engines.
STEPS = [
    (r"(?m)^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$", " "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement|non infringement", "noninfringement"),
    (r"https?://", ""),
    (r"version\s+|v\.?\s?([0-9])", "$1"),
    (r"[^a-z0-9]+", " "),
    (r"all rights reserved", ""),
    (r"neither the names? of .{1,120}? nor the names of", "neither the name of the holder nor the names of"),
    (r"provided by .{1,120}? as is", "provided by the holder as is"),
    (r"in no event shall .{1,160}? be liable", "in no event shall the holder be liable"),
    (r" +", " "),
]
#: Letters of a canonical form by which places of full texts are found.
HEAD = 32


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null and for texts without letters or digits."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def known(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES, full: list[tuple[str, str, int, str, bool]] = FULL) -> DataFrame:
    """(license_id, digest, size, head, core) of notices, which have no head, and of full texts.

    full: id, digest, size and first HEAD letters of a canonical form, and whether
    it is the text's core, which its other forms (with a title, with an
    appendix) hold. Of equal digests the least id stays. A notice without any of
    WORDS can't be found and is refused.
    """
    for _, text in notices:
        if not any(w in text.lower() for w in WORDS):
            raise ValueError(f"none of {WORDS} is in {text!r}")
    made = spark.createDataFrame(notices, "license_id string, text string").select("license_id", canonical(F.col("text")).alias("form"))
    made = made.where("form <> ''").select("license_id", F.sha2("form", 256).alias("digest"), F.length("form").alias("size"), F.lit(None).cast("string").alias("head"), F.lit(True).alias("core"))
    made = made.unionByName(spark.createDataFrame(full, "license_id string, digest string, size int, head string, core boolean"))
    return made.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.first("size").alias("size"), F.first("head").alias("head"), F.max("core").alias("core"))


def _worded(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in WORDS])


def scan(docs: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 100_000) -> DataFrame:
    """(doc_id, license_id, n_parts, whole) for each licence that a document bears.

    n_parts: places where it stands: lines and paragraphs of several lines that
    are a notice, and full texts anywhere (their cores, so a title adds none).
    whole: the whole text is it. licenses: as `known` makes them, up to `most`
    rows, which are broadcast. Null, empty and blank texts bear none; a text of
    any length is read as a whole; rows of one id, or without one, are one
    document. Other columns aren't read. An empty table, of documents or of
    licences, gives an empty one.
    """
    table = licenses.limit(most + 1).collect()
    if len(table) > most:
        raise ValueError(f"more than {most} licences")
    short, long = [r for r in table if r["head"] is None], [r for r in table if r["head"] is not None]
    spark, whole = docs.sparkSession, F.coalesce(F.col(text).cast("string"), F.lit(""))
    worded = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text")).where(_worded(whole)).withColumn("form", canonical(F.col("text")))
    schema = "license_id string, digest string, size int, head string, core boolean"
    columns = [c.split()[0] for c in schema.split(", ")]
    listed = lambda rows: F.broadcast(spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema))

    lines, paragraphs = F.split("text", "\n"), F.filter(F.split("text", r"\n\s*\n"), lambda p: p.rlike(r"\S\s*\n\s*\S"))
    parts = F.filter(F.concat(lines, paragraphs), lambda p: (F.length(p) >= min([r["size"] for r in short], default=0)) & _worded(p))
    units = worded.select("doc_id", F.sha2("form", 256).alias("all"), F.explode(parts).alias("part")).select("doc_id", "all", canonical(F.col("part")).alias("unit"))
    units = units.where(F.length("unit").isin(sorted({r["size"] for r in short}))).select("doc_id", "all", F.sha2("unit", 256).alias("digest"))
    notices = units.join(listed(short), "digest").select("doc_id", "license_id", F.lit(1).alias("n"), (F.col("all") == F.col("digest")).alias("whole"))

    # Cut before each head; a piece's start is the length of those before it.
    heads = sorted({r["head"] for r in long}) or ["\0"]
    pieces = F.split("form", f"(?<![a-z0-9])(?={'|'.join(heads)})")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(held, piece):
        return F.struct((held["at"] + F.length(piece)).alias("at"), F.concat(held["all"], F.array(held["at"])).alias("all"))

    headed = worded.where(F.col("form").rlike("|".join(heads))).select("doc_id", "form", F.explode(F.aggregate(pieces, start, step, lambda held: held["all"])).alias("at"))
    placed = headed.withColumn("head", F.substring("form", F.col("at"), F.lit(HEAD)))
    met = placed.join(listed(long), "head").where(F.sha2(F.substring("form", F.col("at"), F.col("size")), 256) == F.col("digest"))
    texts = met.select("doc_id", "license_id", F.col("core").cast("int").alias("n"), (F.length("form") == F.col("size")).alias("whole"))
    return notices.unionByName(texts).groupBy("doc_id", "license_id").agg(F.sum("n").alias("n_parts"), F.max("whole").alias("whole"))
