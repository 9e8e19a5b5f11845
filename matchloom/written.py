"""Steps written to the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only in local mode, where that is unset, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(at or os.path.join(tempfile.gettempdir(), 'matchloom-steps')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once: its readers don't run its plan again, and lost executors don't lose it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
