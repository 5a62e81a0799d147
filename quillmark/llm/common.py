"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the word contracts define it: space and the five ASCII controls.
SPACE = " \t\n\x0b\x0c\r"
#: The same set as a regular-expression class, for Spark's and Python's engines.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: str.translate table for the ASCII-only lower-casing of the contracts.
ASCII_LOWER = {ord(u): lo for u, lo in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: In a worker process: what each operator remembers from task to task, by how to forget it.
_remembered: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Called in a worker at a task's end: memory that is free goes back to the system, as Spark keeps the process for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def remember_alone(operator: str, forget: Callable[[], None]) -> None:
    """Called in a worker before an operator fills its memory: the other operators' is given back,
    as Spark uses a worker process for the tasks of all of them."""
    for name in [n for n in _remembered if n != operator]:
        _remembered.pop(name)()
        give_back()
    _remembered[operator] = forget


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` has it in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def ascii_lower(text):
    """Column: A-Z lowered, every other character left alone."""
    return F.translate(text, UPPER, LOWER)


def lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def remainder(doc_id, modulus: int):
    """Column: crc32 of the id's decimal text modulo `modulus` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def blocks(batch: pa.RecordBatch, text: int, budget: int = 2 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `budget` bytes of text each, so that what a
    worker holds doesn't depend on the batch size that Spark was given."""
    column, start, held = batch.column(text), 0, 0
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and (held + n > budget or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    outputs: list[T.StructField],
    text: str = "text",
) -> DataFrame:
    """`df` with columns computed by Python from a text column, block by block.

    `make` runs once in a worker and returns a function from a list of texts to
    one Arrow array per output. A null text is given as the empty string. An
    input column with an output's name is replaced; all others are kept.
    """
    names = {f.name.lower() for f in outputs}
    source = fresh(df, "__source_text")
    kept = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType([*[df.schema[c] for c in kept], *outputs])
    # A text that is kept goes to the worker once.
    own = [i for i, c in enumerate(kept) if c.lower() == text.lower() and df.schema[c].dataType == T.StringType()]
    at = own[0] if len(own) == 1 else len(kept)
    given = df.select(*[F.col(f"`{c}`") for c in kept], *([] if len(own) == 1 else [F.col(f"`{text}`").cast("string").alias(source)]))

    def run(batches):
        apply = make()
        for batch in batches:
            for block in blocks(batch, at):
                texts = [x or "" for x in block.column(at).to_pylist()]
                made = [a if isinstance(a, pa.Array) else pa.array(a) for a in apply(texts)]
                yield pa.RecordBatch.from_arrays([*block.columns[: len(kept)], *made], names=schema.names)
        give_back()

    return given.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the cluster names in
    spark.checkpoint.dir or, on a local master where that is unset, as in tests, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="quillmark-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read back: smaller than a
    checkpoint, and to be deleted with the folder when the application has ended."""
    path = f"{shared_folder(df.sparkSession)}/quillmark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def among(df: DataFrame, column: str, ids: DataFrame, limit: int = 500_000, null_safe: bool = False) -> DataFrame:
    """Rows of `df` whose `column` occurs in the one column of `ids` (distinct); null counts as a value if null_safe, and is nowhere else.

    Up to `limit` ids (4 MB as longs) are broadcast, which spares moving the
    rows of `df`; more are joined by a shuffle.
    """
    ids = ids.toDF("__wanted")
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, df[column].eqNullSafe(ids["__wanted"]) if null_safe else df[column] == ids["__wanted"], "left_semi")


def without(df: DataFrame, column: str, ids: DataFrame, limit: int = 500_000) -> DataFrame:
    """Rows of `df` whose `column` doesn't occur in the one column of `ids`; null counts as a value. Broadcast as in `among`."""
    ids = saved(ids.toDF("__unwanted").distinct())
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, df[column].eqNullSafe(ids["__unwanted"]), "left_anti")
