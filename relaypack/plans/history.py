"""From a runtime's own history to a packet: scan its items, normalize, compile, and give the packet in the runtime's shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.operators import compiler
from relaypack.operators.frames import Frames, Policy, frames
from relaypack.operators.payloads import delivery
from relaypack.operators.shared import cut
from relaypack.sources import scans


def _compiled(f: Frames, failed: DataFrame, contract: compiler.Contract, cleanup: Sequence[Policy]) -> tuple[compiler.Compilation, DataFrame]:
    failed = cut(failed, "failed")
    f = f.with_(messages=cut(f.messages, "scanned"))
    for code in ("handoff_integrity", "unsupported_adapter_mode"):
        f = f.deny("adapter", code, failed.where(F.col("code") == code), written=True)
    out, _ = compiler.compile_history(f, contract, cleanup)
    text = out.packets.join(f.handoffs.select("handoff_id", "receiver"), "handoff_id").select("handoff_id", "receiver", F.col("receiver_text").alias("text"))
    return out, delivery(text)


def compile_snapshots(spark: SparkSession, handoffs: DataFrame, snapshots: DataFrame, contract: compiler.Contract, cleanup: Sequence[Policy] = ()) -> tuple[compiler.Compilation, DataFrame]:
    """(compilation, delivery) of agents' run snapshots (handoff_id, history, pre_items, input_items, new_items). Broken tool pairs and unknown items deny."""
    messages, failed = scans.snapshot_messages(cut(scans.snapshot_items(snapshots), "items"))
    return _compiled(frames(spark, handoffs, messages, nested=True), failed, contract, cleanup)


def compile_graph(spark: SparkSession, handoffs: DataFrame, rows: DataFrame, contract: compiler.Contract, cleanup: Sequence[Policy] = ()) -> tuple[compiler.Compilation, DataFrame]:
    """(compilation, delivery) of a chat graph's state (handoff_id, pos, item)."""
    messages, failed = scans.graph_messages(cut(rows, "items"))
    return _compiled(frames(spark, handoffs, messages, nested=True), failed, contract, cleanup)
