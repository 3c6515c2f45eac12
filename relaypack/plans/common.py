"""Tables of the driver as handoffs: conversations are histories, documents are texts to clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.operators.frames import Frames, frames, text_messages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return text_messages(c, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))


def conversation_frames(spark: SparkSession, sf_dir: str) -> Frames:
    m = conversation_messages(spark, sf_dir)
    heads = m.select("handoff_id").distinct().withColumns({"sender": F.lit("sender"), "receiver": F.lit("receiver"), "metadata_json": F.lit("{}")})
    return frames(spark, heads, m)


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    """Literal rows, as SQL."""
    return spark.sql(f"select * from values {rows} as t({names})")
