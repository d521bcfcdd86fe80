"""Counters over fixed windows that open with a key's first event after the last window ended.

The windows hang on one another, so a key's events are folded in order. They are sorted by Spark and streamed through
one task in batches with a constant state; no group is held in memory.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def anchored(events: DataFrame, key: list[str], ts: str, window: int, order: list[str]) -> DataFrame:
    """`events` with window_start and place (1 for the event that opens the window). `ts` is a long.

    Events without a time are left out; null keys are one key.
    """

    def fold(batches):
        held, start, n = None, 0, 0
        for b in batches:
            k, t = b["_key"].to_numpy(), b[ts].to_numpy(np.int64)
            starts, places = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            cuts = [*np.flatnonzero(k[1:] != k[:-1]) + 1, len(b)] if len(b) else []
            i = 0
            for end in cuts:
                if k[i] != held:
                    held, start, n = k[i], t[i], 0
                while i < end:
                    if t[i] - start >= window:
                        start, n = t[i], 0
                    j = i + int(np.searchsorted(t[i:end], start + window))
                    starts[i:j], places[i:j] = start, np.arange(n + 1, n + 1 + j - i)
                    n, i = n + j - i, j
            yield b.drop(columns="_key").assign(window_start=starts, place=places)

    keyed = events.where(F.col(ts).isNotNull()).withColumn("_key", F.to_json(F.struct(*key)))
    met = keyed.repartition("_key").sortWithinPartitions("_key", ts, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return met.mapInPandas(fold, f"{fields}, window_start long, place long")


def rate_limit(events: DataFrame, key: list[str], ts: str, limit: int, window: int = 60_000, order: list[str] = ()) -> DataFrame:
    """Whether each call is admitted: the first `limit` of its window are, and only they count. 0 turns the limit off."""
    seen = anchored(events, key, ts, window, list(order))
    return seen.withColumn("admitted", F.lit(limit == 0) | (F.col("place") <= limit)).drop("place")


def breaker(events: DataFrame, key: list[str], ts: str, most: int, window: int = 10_000, order: list[str] = ()) -> DataFrame:
    """Whether each delivery trips the breaker: every delivery counts, and those past `most` of a window trip."""
    return anchored(events, key, ts, window, list(order)).withColumn("tripped", F.col("place") > most).drop("place")
