"""Append-only stores and exports."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from quillmark.functions.hashing import canonical_json


def append_new(rows: DataFrame, path: str, key: str, partition: str | None = None) -> int:
    """Appends rows whose key the store lacks; how many. A key that comes twice in `rows` is an error."""
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated {key}")
    try:
        there = rows.sparkSession.read.parquet(path).select(key)
        rows = rows.join(there, key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # The store is new.
    rows = rows.cache()
    n = rows.count()
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    rows.unpersist()
    return n


def manifest(store: DataFrame, key: str, *parts: str) -> DataFrame:
    """Rows, versions and digest of each key of a store."""
    return store.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]))), ","), 256).alias("digest"))


def flat(rows: DataFrame) -> DataFrame:
    """Lists as text joined by semicolons, for CSV."""
    return rows.select(*[F.concat_ws(";", F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    flat(rows).orderBy(*order).write.option("header", True).option("nullValue", "").csv(path)


def export_json(rows: DataFrame, path: str, order: list[str]) -> None:
    rows.orderBy(*order).write.option("ignoreNullFields", False).json(path)


def long_analysis(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, predictor, outcome, n, value, status) of several analyses together; columns that one lacks are null."""
    names = {"predictor": "string", "outcome": "string", "n": "bigint", "value": "double", "status": "string"}
    out = None
    for section, rows in sections.items():
        one = rows.select(F.lit(section).alias("section"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
        out = one if out is None else out.unionByName(one)
    return out


def proposal_json(proposal: Mapping[str, Any], path: str | None = None) -> str:
    """A proposal or draft policy as canonical JSON, written to a local path if one is told."""
    made = canonical_json(proposal, wrapped=False)
    if path is not None:
        Path(path).write_text(made, encoding="utf-8")
    return made


def records_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """Canonical records (a `record` column, see `operators.workflow.projected`), one a line, in order."""
    rows.orderBy(*order).select("record").write.text(path)
