"""Tool calls and their results: pairing by call id, in order, one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions import tokens as tk

#: Item types of calls and of their outputs.
CALLS = ("function_call", "computer_call", "local_shell_call", "shell_call", "apply_patch_call", "custom_tool_call", "mcp_approval_request")
OUTPUTS = ("function_call_output", "computer_call_output", "local_shell_call_output", "shell_call_output", "apply_patch_call_output", "custom_tool_call_output", "mcp_approval_response")


def marks(items: DataFrame, *, group: str = "handoff_id", place: str = "pos", call_id: str = "call_id", is_call: str = "is_call") -> DataFrame:
    """Adds ``error`` to rows of calls and outputs: missing_call_id, reused_call_id, orphan_output, duplicate_output; null if fine.

    An output needs an earlier call of its id and completes it once; a call may not take an id again.
    """
    w = Window.partitionBy(group, call_id).orderBy(place)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    calls, outs = F.coalesce(F.count_if(F.col(is_call)).over(before), F.lit(0)), F.coalesce(F.count_if(~F.col(is_call)).over(before), F.lit(0))
    error = (
        F.when(F.col(call_id).isNull() | (F.trim(call_id) == ""), "missing_call_id")
        .when(F.col(is_call) & (calls > 0), "reused_call_id")
        .when(~F.col(is_call) & (calls == 0), "orphan_output")
        .when(~F.col(is_call) & (outs > 0), "duplicate_output")
    )
    return items.withColumn("error", error)


def pairs(items: DataFrame, *, group: str = "handoff_id", place: str = "pos", call_id: str = "call_id", is_call: str = "is_call") -> DataFrame:
    """group, call_id, call_pos, output_pos (null: unfinished) of sound pairs, by one grouping instead of a self-join."""
    ok = marks(items, group=group, place=place, call_id=call_id, is_call=is_call).where("error is null")
    return ok.groupBy(group, call_id).agg(F.min(F.when(F.col(is_call), F.col(place))).alias("call_pos"), F.min(F.when(~F.col(is_call), F.col(place))).alias("output_pos"))


def pending(items: DataFrame, *, group: str = "handoff_id", place: str = "pos") -> DataFrame:
    """Adds ``open_calls`` before each row (is_call null: no tool row), and ``interrupts``: another message while calls wait."""
    w = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("is_call"), 1).when(~F.col("is_call"), -1).otherwise(0)
    out = items.withColumn("open_calls", F.coalesce(F.sum(step).over(w), F.lit(0)))
    return out.withColumn("interrupts", F.col("is_call").isNull() & (F.col("open_calls") > 0))


def validate(items: DataFrame, *, allow_unfinished: bool = False, strict_order: bool = False) -> DataFrame:
    """handoff_id, code of each handoff whose tool rows aren't sound: the first error by place, else unfinished_call."""
    tool = marks(items.where("is_call is not null"))
    bad = tool.where("error is not null").select("handoff_id", "pos", "error")
    if strict_order:
        bad = bad.union(pending(items).where("interrupts").select("handoff_id", "pos", F.lit("message_while_pending").alias("error")))
    first = bad.groupBy("handoff_id").agg(F.min_by("error", "pos").alias("code"))
    if allow_unfinished:
        return first
    late = pairs(tool.drop("error")).where("output_pos is null").select("handoff_id").distinct()
    return first.unionByName(late.join(first, "handoff_id", "left_anti").withColumn("code", F.lit("unfinished_call")))


def result_content(call_id: Column, name: Column, arguments: Column, output: Column) -> Column:
    """JSON content of a collapsed pair; all are texts."""
    return F.concat(F.lit('{"tool_result":{"call_id":'), tk.literal(call_id), F.lit(',"name":'), tk.literal(name), F.lit(',"arguments":'), tk.literal(arguments), F.lit(',"output":'), tk.literal(output), F.lit("}}"))


def same_multiset(before: DataFrame, after: DataFrame) -> DataFrame:
    """handoff_id of groups whose control rows (handoff_id, descriptor) changed: one count a row, no self-join."""
    n = before.select("handoff_id", "descriptor", F.lit(1).alias("d")).unionAll(after.select("handoff_id", "descriptor", F.lit(-1).alias("d")))
    return n.groupBy("handoff_id", "descriptor").agg(F.sum("d").alias("d")).where("d <> 0").select("handoff_id").distinct()
