"""What the operators of this subpackage share: inputs, checkpoints and Arrow tasks."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word rule; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to Python at a time while a step is written; each operator works in slices of bounded bytes, so any number is right.
BATCH_ROWS = "2000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Lets a step's shuffle files go when it is written; what it wrote is all that later steps read.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir; only in local mode, where that is unset, a folder of our own."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or (context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else None)
    if at is None and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return at or os.path.join(tempfile.gettempdir(), "matchloom-checkpoints")


@contextmanager
def batches_of(spark: SparkSession):
    """The session hands Python so many rows at a time within, and drops a write's shuffle files after it; its own settings come back."""
    before = {k: spark.conf.get(k) for k in (_BATCH, _CLEANUP)}
    spark.conf.set(_BATCH, BATCH_ROWS)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def checkpointed(df: DataFrame, what: str) -> DataFrame:
    """`df`, written to the shared folder and read back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    with batches_of(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step._step_path = path
    return step


def discarded(*steps: DataFrame) -> None:
    """Deletes what `checkpointed` wrote for these frames, once all that reads them is written itself."""
    for step in steps:
        spark = step.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(step._step_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as columns `doc_id` and `text`; further columns, whatever their names, go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: What operators remember in a worker process beyond a task, by owner.
_remembered: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """An owner's memory in this process; it lasts until a task of another owner runs here."""
    return _remembered.setdefault(owner, {})


def forget_others(owner: str) -> None:
    """A function of the module, so that it reaches the worker's own memory and not a copy that came with a task."""
    for other in [k for k in _remembered if k != owner]:
        del _remembered[other]


def give_back() -> None:
    """Returns what a task has freed to the system: a worker that waits would hold it beside the next stages, which need no Python."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, task: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list], schema, owner: str = "") -> DataFrame:
    """mapInArrow with a function of one batch.  What other owners than `owner` remember in the worker goes first, as workers serve all stages in turn."""

    def run(batches):
        forget_others(owner)
        for batch in batches:
            yield from task(batch)
            del batch
        give_back()

    return df.mapInArrow(run, schema)


#: Bytes that may be broadcast, once rows have been counted.
BROADCAST_BYTES = 16_000_000


def row_bytes(df: DataFrame) -> int:
    """About what a row takes in a broadcast: 16, and for each column 8, or 64 where it has no fixed width."""
    return 16 + sum(8 if isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType) else 64 for f in df.schema.fields)


def counted(df: DataFrame) -> DataFrame:
    """`df`, marked for a broadcast if its counted rows take at most BROADCAST_BYTES; else joins shuffle it."""
    return F.broadcast(df) if df.count() * row_bytes(df) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
