"""Named stages with their time and counters."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("matchloom")


@dataclass
class Stage:
    name: str
    seconds: float = 0.0
    counts: dict[str, int] = field(default_factory=dict)


STAGES: list[Stage] = []


@contextmanager
def stage(name: str):
    done, began = Stage(name), time.perf_counter()
    try:
        yield done.counts
    finally:
        done.seconds = time.perf_counter() - began
        STAGES.append(done)
        LOG.info("%s: %.3f s %s", name, done.seconds, done.counts)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`df`, whose rows are counted as some action computes them."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen
