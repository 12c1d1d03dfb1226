"""Streams: rolling windows with late data, and progress marks kept by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling(stream: DataFrame, clock: str, keys: list[str], length: str, slide: str, late: str, value: str) -> DataFrame:
    """Counts and sums in sliding windows; rows later than ``late`` are dropped."""
    own = stream.withWatermark(clock, late).groupBy(F.window(clock, length, slide).alias("w"), *keys)
    return own.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark, seen = state.get if state.exists else (0, 0)
    for rows in batches:
        fresh = rows[rows["sequence"] > mark]
        seen += len(fresh)
        mark = max([mark, *fresh["sequence"].tolist()])
    state.update((int(mark), int(seen)))
    yield pd.DataFrame({"conversation": [key[0]], "mark": [int(mark)], "seen": [int(seen)]})


def marks(stream: DataFrame) -> DataFrame:
    """Per conversation the highest sequence seen and how many events advanced it: progress, not event time.

    Marks never move backwards; repeated or older events change nothing.
    """
    return stream.select("conversation", "sequence").groupBy("conversation").applyInPandasWithState(_advance, "conversation string, mark long, seen long", "mark long, seen long", "update", GroupStateTimeout.NoTimeout)


def due(moment: str, pending: int, since_last: float, running: bool, threshold: int = 10, throttle: float = 120.0) -> bool:
    """Trigger policy: never while running; at a close always; else by backlog, at most once in ``throttle`` seconds."""
    if running:
        return False
    return moment == "close" or (pending >= threshold and since_last >= throttle)
