"""Streams, an extension: windowed event counts with late data, and the last word on each key kept as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYED = "scope string, state_key string, section string, place bigint, content string"
CHANGE = "scope string, state_key string, section string, place bigint, content string, alive boolean"


def event_counts(stream: DataFrame, *, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out by Spark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def last_writer(stream: DataFrame) -> DataFrame:
    """A stream of changes (scope, state_key, section, place, content, alive): the row that now is the last of its key and section.

    A row that comes late by place doesn't win. Completed work closes pending work before it. State holds one row per key and section.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        out: dict[str, dict] = {}
        for df in batches:
            for r in df.itertuples(index=False):
                if r.place >= held.get(r.section, -1):
                    held[r.section] = int(r.place)
                    out[r.section] = {"scope": key[0], "state_key": key[1], "section": r.section, "place": r.place, "content": r.content}
        state.update((list(held), list(held.values())))
        done = held.get("completed_work", -1)
        if "completed_work" in out and "pending_work" in held and "pending_work" not in out and held["pending_work"] < done:
            out["pending_work"] = {"scope": key[0], "state_key": key[1], "section": "pending_work", "place": held["pending_work"], "content": None}
        rows = [{**v, "alive": not (s == "pending_work" and done > v["place"])} for s, v in sorted(out.items())]
        yield pd.DataFrame(rows, columns=["scope", "state_key", "section", "place", "content", "alive"])

    return stream.groupBy("scope", "state_key").applyInPandasWithState(step, CHANGE, "sections array<string>, places array<bigint>", "update", "NoTimeout")
