"""Offers put together from a stream of lines that arrive late, in pieces, out of order and more than once.

State of an offer: the numbers of its lines and the number that its sender called the last.  An offer closes as soon as no number is missing, or when the
watermark passes the time of its last line by `patience`; lines that come after that open no second offer while its mark is
kept.  State is a set of numbers, not the lines, which go to the store as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "offer_id string, lines int, last_line int, repeated int, missing array<int>, complete boolean, closed_by string"
_STATE = "numbers array<int>, last_line int, repeated int, latest long, closed boolean"
#: Missing numbers that a closed offer lists.
SHOWN_MISSING = 100


def assembled(stream: DataFrame, late: str = "10 minutes", patience_ms: int = 600_000) -> DataFrame:
    """One row for each offer that closes: offer_id, lines, last_line, repeated, missing, complete, closed_by (numbers or time).

    `stream`: offer_id, line_no, last_line (the last number, where a line knows it; else null), at (when it was sent).
    Rows without an offer or number, and numbers below 1, are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, last, repeated, latest, closed = ({*state.get[0]}, *state.get[1:]) if state.exists else (set(), None, 0, 0, False)

        def row(by: str) -> pd.DataFrame:
            end = max(max(numbers, default=0), last or 0)
            missing = [k for k in range(1, end + 1) if k not in numbers]
            return pd.DataFrame([(key[0], len(numbers), end, repeated, missing[:SHOWN_MISSING], not missing and last is not None, by)], columns=["offer_id", "lines", "last_line", "repeated", "missing", "complete", "closed_by"])

        if state.hasTimedOut:
            if not closed:
                yield row("time")
            state.remove()
            return
        for frame in frames:
            for number, end, at in zip(frame["line_no"].tolist(), frame["last_line"].tolist(), frame["at_ms"].tolist(), strict=True):
                repeated += number in numbers
                numbers.add(int(number))
                if end == end and end is not None:
                    last = max(last or 0, int(end))
                latest = max(latest, int(at))
        done = last is not None and len(numbers) >= last and numbers >= set(range(1, last + 1))
        if done and not closed:
            closed = True
            yield row("numbers")
        state.update((sorted(numbers), last, repeated, latest, closed))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + patience_ms)

    rows = stream.where("offer_id IS NOT NULL AND line_no >= 1").withWatermark("at", late)
    rows = rows.select("offer_id", F.col("line_no").cast("int").alias("line_no"), F.col("last_line").cast("int").alias("last_line"), F.unix_millis("at").alias("at_ms"), "at")
    return rows.groupBy("offer_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
