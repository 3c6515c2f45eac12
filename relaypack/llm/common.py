"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session without one gets a temporary folder; a cluster must name its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="relaypack-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again. It survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def blocks_for(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def text_slices(texts, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of an Arrow column in runs of about ``most`` bytes, null as empty: only a run's texts are Python objects at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = min(len(texts), int(np.searchsorted(size, before + most)) + 1)
        yield at, [x or "" for x in texts.slice(at, end - at).to_pylist()]
        at = end
