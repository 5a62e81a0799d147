"""A corpus pipeline of the operators: what it keeps is clean, unique, unleaked, without secrets, and encoded."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, decontam, minhash, secrets, toxicity
from quillmark.llm.common import fresh, shared_folder, table

#: Documents with this toxicity or more go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on the labelled ones, doesn't reject.

    Null, empty and very long texts are scored like any other. Equal texts go or
    stay together, repeated rows too. An empty table gives an empty one.
    Further columns, whatever their names, stay as they are.
    """
    model, out = toxicity.fitted(docs, table(spark, sf_dir, "labels")), fresh(docs, "__toxicity")
    return toxicity.score(docs, model, out=out).where(F.col(out) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a likeness of 0.8 or more.

    The least id stays, of rows that repeat an id the one with the least text.
    Null, empty and blank texts, and rows without an id, are duplicates of
    nothing. An empty table gives an empty one; further columns stay.
    """
    return minhash.deduplicated(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item.

    Rows of one id, or without one, are judged together and go or stay together.
    Null, empty and blank texts overlap nothing. An empty table, of documents or
    of items, gives back what is there; further columns stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars told anew where text changed.

    Null texts stay null, repeated rows stay equal, texts of any length are read
    as a whole. An empty table gives an empty one; further columns stay.
    """
    changed = fresh(docs, "__changed")
    # The redacted text takes the place of the text, so that workers hold one of them.
    found = secrets.redact(docs, secrets.train(secrets.sampled(docs, 4000)), out="text", changed=changed)
    own = {"n_chars": F.when(F.col(changed), F.length("text").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, 32-bit little-endian) of every text, and how many, instead of the text.

    A null text is encoded as the empty one, to no ids. All rows and all other
    columns stay; one named as an output is replaced.
    """
    outputs = ("text", "n_tokens", "token_ids", "decoded_sha256")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    made = bpe.encode(docs.select(*[F.col(f"`{c}`") for c in kept], "text"), decoded="text")
    return made.select(*[F.col(f"`{c}`") for c in kept], bpe.n_tokens(F.col("token_ids")).alias("n_tokens"), "token_ids", F.sha2("text", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode_tokens),
]

#: The toxicity model, secret models and BPE have no SQL. Tests hold run() against a version by hand: exact
#: likeness of shingle sets, every window against every item, and the library's own encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
