"""Canonical JSON and digests."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_value(value: Any) -> Any:
    """NFC text, wrapped floats, lists for tuples; what isn't a finite number is refused."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("only finite numbers have a canonical form")
        return {"__float__": repr(value)}
    if isinstance(value, dict):
        return {unicodedata.normalize("NFC", str(k)): canonical_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [canonical_value(v) for v in value]
    return value


def canonical_json(value: Any, wrapped: bool = True) -> str:
    """Sorted keys and no blanks; floats wrapped and text as it is, or floats bare and text escaped to ASCII."""
    if wrapped:
        return json.dumps(canonical_value(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def canonical_digest(value: Any, wrapped: bool = True) -> str:
    return hashlib.sha256(canonical_json(value, wrapped).encode("utf-8")).hexdigest()


def json_digest(text: Column, wrapped: bool = True) -> Column:
    """Digest of the canonical form of JSON text, by Arrow batches (Spark can't sort keys)."""

    @F.pandas_udf(T.StringType())
    def run(values):
        return values.map(lambda v: None if v is None else canonical_digest(json.loads(v), wrapped))

    return run(text)


def row_digest(*columns: Column) -> Column:
    """Digest of a row inside Spark: values as text, nulls kept apart from empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of all leaves of a schema."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += paths(f.dataType, f"{name}.") if isinstance(f.dataType, T.StructType) else [name]
    return out


def flattened(schema: T.StructType) -> list[Column]:
    """A column for each leaf, named by its dotted path with underscores."""
    return [F.col(p).alias(p.replace(".", "_")) for p in paths(schema)]


def unproven(present: Column, proven: Column) -> Column:
    """Paths of values for which there is no evidence."""
    return F.array_sort(F.array_except(present, proven))


def told_paths(df: DataFrame, record: str) -> Column:
    """Dotted names of the leaves of a struct column that hold a value, in its fields' order."""
    leaves = paths(df.schema[record].dataType)
    return F.filter(F.array(*[F.when(F.col(f"{record}.{p}").isNotNull(), F.lit(p)) for p in leaves]), lambda p: p.isNotNull())


def merged(df: DataFrame, records: list[str]) -> Column:
    """Struct columns of one type merged leaf by leaf: the first of `records` that tells a leaf wins."""

    def level(schema: T.StructType, prefix: str) -> Column:
        made = []
        for f in schema.fields:
            at = f"{prefix}.{f.name}"
            made.append((level(f.dataType, at) if isinstance(f.dataType, T.StructType) else F.coalesce(*[F.col(f"{r}{at}") for r in records])).alias(f.name))
        return F.struct(*made)

    return level(df.schema[records[0]].dataType, "")


#: What a snapshot's digest leaves out, as it changes from reading to reading.
AGES = ("age_hours", "age_days")


def payload_digest(snapshot: Column) -> Column:
    """Digest of a snapshot's canonical form without its ages."""
    return json_digest(F.to_json(snapshot.dropFields(*AGES)), wrapped=False)
