"""JSON documents, connector payloads and stores."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_json(text: str) -> Any:
    """Parsed JSON; a repeated key or a number that isn't finite is an error."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ValueError(f"repeated keys: {sorted({k for k in keys if keys.count(k) > 1})}")
        return dict(items)

    def refuse(name):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row for each JSON file; a malformed file, or one with repeated keys, stops the read."""

    @F.pandas_udf(T.StringType())
    def checked(texts):
        return texts.map(lambda t: json.dumps(strict_json(t)))

    raw = spark.read.option("wholetext", True).text(path).select(checked("value").alias("value"), F.input_file_name().alias("file"))
    return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"), "file").select("d.*", "file")


def aliased(payload: str, names: list[str], kind: str = "string") -> Column:
    """The first of several JSON paths of a payload column that has a value."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names]).try_cast(kind)


#: Keys under which connectors give their values.
SUBSCRIPTION = {"qib_x": ["qib_x", "qib", "qib_times"], "nii_x": ["nii_x", "nii", "hni", "nii_times"], "retail_x": ["retail_x", "retail", "rii", "retail_times"], "overall_x": ["overall_x", "overall", "total", "total_times"]}
TRENDS = {"bullish": "supportive", "up": "supportive", "supportive": "supportive", "sideways": "neutral", "flat": "neutral", "neutral": "neutral", "bearish": "weak", "down": "weak", "weak": "weak"}


def subscriptions(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Subscription multiples; a negative one is an error."""
    out = payloads
    for name, keys in SUBSCRIPTION.items():
        value = aliased(payload, keys, "double")
        out = out.withColumn(name, F.when(value < 0, F.raise_error(F.lit(f"negative {name}")).cast("double")).otherwise(value))
    return out


def market_regime(trend: Column) -> Column:
    """Synonyms to supportive, neutral or weak; null for others."""
    known = F.create_map(*[F.lit(x) for kv in TRENDS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(trend)))


def grey_market(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Premium in percent, from percent or from money and price; both, if they disagree, are an error."""
    percent, money, price = aliased(payload, ["gmp_pct", "pct"], "double"), aliased(payload, ["gmp", "gmp_inr"], "double"), aliased(payload, ["price", "issue_price"], "double")
    derived = F.try_divide(money * 100, price)
    clash = F.abs(percent - derived) > 0.5
    return payloads.withColumn("gmp_pct", F.when(clash, F.raise_error(F.lit("ambiguous premium")).cast("double")).otherwise(F.coalesce(percent, derived))).withColumn("gmp_trend", F.lower(aliased(payload, ["trend", "gmp_trend"])))


PEER = "array<struct<name:string,pe:double,ev_ebitda:double,pb:double,ps:double,roe_pct:double,as_of:string>>"


def peers(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """One row for each peer of a payload."""
    return payloads.select(key, F.explode(F.from_json(F.get_json_object(payload, "$.peers"), PEER)).alias("p")).select(key, "p.*")


def anchors(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    return payloads.select(key, aliased(payload, ["quality", "anchor_quality"]).alias("anchor_quality"), aliased(payload, ["as_of", "allotted_on"]).alias("as_of"))


def digest_of_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("digest"))


def exchange_rows(payloads: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, company, series, is_open, price_low, price_high) of each entry of captured exchange lists ("data", "payload" text column)."""
    entry = "struct<companyName:string,series:string,status:string,issuePrice:string>"
    rows = payloads.select(*keep, F.explode(F.from_json("payload", f"struct<data:array<{entry}>>")["data"]).alias("x"))
    numbers = F.transform(F.regexp_extract_all("x.issuePrice", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda v: v.cast("double"))
    return rows.select(*keep, F.trim("x.companyName").alias("company"), F.upper("x.series").alias("series"), (F.lower("x.status") == "active").alias("is_open"), F.array_min(numbers).alias("price_low"), F.array_max(numbers).alias("price_high"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluations: a Parquet store."""
    return spark.read.parquet(path)


def read_evaluations(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Evaluation documents, one a file, with the name of the directory that holds each; a file that isn't JSON is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern)
    return rows.withColumn("directory", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_observations(spark: SparkSession, root: str, evaluation_id: str, schema: str) -> DataFrame:
    """An evaluation's observations in the order of their file names."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/{evaluation_id}/observations/*.json")
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("file")


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An exported dataset, in the canonical order of time, issuer and evaluation."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).orderBy("evaluated_at", "ipo_id", "evaluation_id")
