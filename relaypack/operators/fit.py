"""Greedy skipping fit: preferred items in order, each kept if it still fits, else skipped.

It is no prefix of the order, so a running sum can't tell it; but with additive bytes it is a fold over integers. ``fit``
folds inside the JVM over one array per handoff. ``fit_stream`` makes the same decisions in one pass over sorted partitions
with a constant state, for handoffs too long for an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "struct<used:bigint,sec:int,kept:array<bigint>>"


def fit(items: DataFrame, start: DataFrame, *, limit: str = "max_bytes") -> DataFrame:
    """Items (handoff_id, ord, pos, bytes) with ``kept``.

    ``start`` has handoff_id, used (bytes taken before) and the limit. Items are tried by (ord, pos); one that follows a kept
    item of its own ord costs a byte more, its comma.
    """
    runs = items.groupBy("handoff_id").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "bytes"))).alias("xs"))
    begin = F.struct(F.col("used").cast("bigint").alias("used"), F.lit(-1).alias("sec"), F.array().cast("array<bigint>").alias("kept"))

    def step(a, x):
        total = a["used"] + x["bytes"] + F.when(a["sec"] == x["ord"], 1).otherwise(0)
        return F.when(total <= F.col(limit), F.struct(total.alias("used"), x["ord"].cast("int").alias("sec"), F.array_append(a["kept"], x["pos"].cast("bigint")).alias("kept")).cast(_STATE)).otherwise(a)

    done = runs.join(start.select("handoff_id", "used", limit), "handoff_id").withColumn("s", F.aggregate("xs", begin.cast(_STATE), step))
    kept = done.select("handoff_id", F.explode("s.kept").alias("pos")).withColumn("kept", F.lit(True))
    return items.join(kept, ["handoff_id", "pos"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def fit_stream(items: DataFrame, start: DataFrame, *, limit: str = "max_bytes") -> DataFrame:
    """(handoff_id, ord, pos, bytes, kept), as fit() decides."""
    rows = items.join(start.select("handoff_id", "used", limit), "handoff_id").select("handoff_id", F.col("ord").cast("long"), F.col("pos").cast("long"), F.col("bytes").cast("long"), F.col("used").cast("long"), F.col(limit).cast("long").alias("most"))
    rows = rows.repartition("handoff_id").sortWithinPartitions("handoff_id", "ord", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, used, sec = None, 0, None
        for batch in batches:
            h, o, p, b, u, most = (batch.column(i).to_pylist() for i in range(6))
            kept = []
            for i, x in enumerate(h):
                if x != who:
                    who, used, sec = x, u[i], None
                total = used + b[i] + (sec == o[i])
                ok = total <= most[i]
                if ok:
                    used, sec = total, o[i]
                kept.append(ok)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(kept)], ["handoff_id", "ord", "pos", "bytes", "kept"])

    return rows.mapInArrow(run, "handoff_id bigint, ord bigint, pos bigint, bytes bigint, kept boolean")
