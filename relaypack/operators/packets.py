"""Packets: the compact canonical text for one receiver, its items, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions import tokens as tk
from relaypack.schema import SECTIONS, section_order

#: Keys of a packet's text, sorted.
KEYS = tuple(sorted((*SECTIONS, "goal", "receiver", "sender")))


def _content() -> Column:
    return F.when(F.col("content_type") == "text", tk.literal(F.col("content"))).otherwise(F.col("content"))


def message_item() -> Column:
    """JSON text of a message row: sorted keys, default fields left out."""
    return F.concat(
        F.lit('{"content":'), _content(),
        F.when(F.col("kind") != "message", F.concat(F.lit(',"kind":'), tk.literal(F.col("kind")))).otherwise(""),
        F.when(F.col("metadata_json") != "{}", F.concat(F.lit(',"metadata":'), F.col("metadata_json"))).otherwise(""),
        F.when(F.col("role") != "user", F.concat(F.lit(',"role":'), tk.literal(F.col("role")))).otherwise(""),
        F.when(F.size("tags") > 0, F.concat(F.lit(',"tags":['), F.array_join(F.transform(F.array_sort("tags"), tk.literal), ","), F.lit("]"))).otherwise(""),
        F.lit("}"),
    )


def artifact_item() -> Column:
    return F.concat(
        F.lit('{"content":'), _content(),
        F.when(F.col("media_type") != "text/plain", F.concat(F.lit(',"media_type":'), tk.literal(F.col("media_type")))).otherwise(""),
        F.when(F.col("metadata_json") != "{}", F.concat(F.lit(',"metadata":'), F.col("metadata_json"))).otherwise(""),
        F.lit(',"name":'), tk.literal(F.col("name")), F.lit("}"),
    )


def render(heads: DataFrame, items: DataFrame) -> DataFrame:
    """handoff_id, receiver_text, packet_bytes, packet_tokens, n_items.

    ``heads``: handoff_id, sender, receiver, goal; ``items``: handoff_id, section, pos, item. Every section is there, empty or not.
    """
    lists = [F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("section") == s, F.struct("pos", "item"))), lambda x: x.isNotNull())), lambda x: x["item"]), ",").alias("_" + s) for s in SECTIONS]
    by = items.groupBy("handoff_id").agg(F.count(F.lit(1)).alias("n_items"), *lists)
    parts = []
    for i, k in enumerate(KEYS):
        parts.append(F.lit("{" * (i == 0) + "," * (i > 0) + f'"{k}":'))
        parts.append(F.concat(F.lit("["), F.coalesce(F.col("_" + k), F.lit("")), F.lit("]")) if k in SECTIONS else tk.literal(F.col(k)))
    text = F.concat(*parts, F.lit("}"))
    out = heads.join(by, "handoff_id", "left").select("handoff_id", text.alias("receiver_text"), F.coalesce("n_items", F.lit(0)).alias("n_items"))
    return out.withColumns({"packet_bytes": F.octet_length("receiver_text").cast("long"), "packet_tokens": tk.text_tokens(F.col("receiver_text"))})


def is_packet(text: Column) -> Column:
    """A JSON object with exactly a packet's keys; anything else is ordinary text."""
    keys = F.json_object_keys(text)
    return F.coalesce((F.size(keys) == len(KEYS)) & (F.size(F.array_except(keys, F.array(*map(F.lit, KEYS)))) == 0), F.lit(False))


def decode(texts: DataFrame, *, key: str = "handoff_id", text: str = "receiver_text") -> DataFrame:
    """One row per item of each packet: key, section, pos, item (JSON text), in the flattening order of sections."""
    def of(s: str) -> Column:
        held = F.from_json(F.get_json_object(text, f"$.{s}"), "array<variant>")
        return F.transform(held, lambda v, i: F.struct(F.lit(s).alias("section"), i.alias("pos"), F.to_json(v).alias("item")))

    every = F.flatten(F.array(*map(of, SECTIONS)))
    return texts.where(is_packet(F.col(text))).select(key, F.explode(every).alias("x")).select(key, "x.section", "x.pos", "x.item")


def flatten(heads: DataFrame, items: DataFrame) -> DataFrame:
    """Packet items as messages of the kind of their section, in one order; the goal goes to the envelope's metadata."""
    place = F.row_number().over(Window.partitionBy("handoff_id").orderBy(section_order(F.col("section")), "pos")) - 1
    rows = items.where("section <> 'artifacts'").withColumn("msg_idx", place.cast("int")).withColumn("kind", F.col("section"))
    return rows.join(heads.select("handoff_id", F.concat(F.lit('{"goal":'), tk.literal(F.col("goal")), F.lit("}")).alias("envelope_metadata")), "handoff_id")


def merge_artifacts(inherited: DataFrame, current: DataFrame) -> DataFrame:
    """Current artifacts replace inherited ones of their name; exact repeats go. Columns: handoff_id, art_idx, name, ..."""
    fields = [c for c in current.columns if c != "art_idx"]
    old = inherited.join(current.select("handoff_id", "name").distinct(), ["handoff_id", "name"], "left_anti").withColumn("_side", F.lit(0))
    every = old.unionByName(current.withColumn("_side", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*fields).orderBy("_side", "art_idx"))
    kept = every.withColumn("_n", first).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("handoff_id").orderBy("_side", "art_idx")) - 1
    return kept.withColumn("art_idx", place.cast("int")).drop("_side").select(*current.columns)


def wrong_receiver(packets: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Handoffs that continue a packet that was not for their sender."""
    got = packets.where(is_packet(F.col("receiver_text"))).select("handoff_id", F.get_json_object("receiver_text", "$.receiver").alias("was_for"))
    return handoffs.join(got, "handoff_id").where("was_for <> sender").select("handoff_id")
