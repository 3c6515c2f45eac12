"""Texts that leave the engine for a model or a receiver: built as columns, from the rows of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaypack.functions import tokens as tk
from relaypack.functions.text import bare_lines
from relaypack.operators.compiler import Contract

BEGIN, END = "<sender_context>", "</sender_context>"
#: Columns of a task that a model may see.
PUBLIC = ("repo", "instance_id", "base_commit", "problem_statement")
#: Metadata that the engine alone writes.
RESERVED = ("relaypack.source_id", "relaypack.source_ids", "relaypack.brief_sources", "relaypack.brief_status", "relaypack.excerpt_source", "relaypack.excerpt_lines", "relaypack.item")


def json_text(c: Column) -> Column:
    """A string as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def stripped(metadata_json: Column, reserved: Sequence[str] = RESERVED) -> Column:
    """Metadata without the keys that only the engine may set, so that a sender can't forge a reference."""
    kept = F.map_filter(F.from_json(metadata_json, "map<string,variant>"), lambda k, _: ~k.isin(*reserved))
    return F.when(F.arrays_overlap(F.coalesce(F.json_object_keys(metadata_json), F.array().cast("array<string>")), F.array(*map(F.lit, reserved))), F.to_json(kept)).otherwise(metadata_json)


def numbered(content: Column) -> Column:
    """The lines of a text with their numbers, from 1."""
    return F.array_join(F.transform(bare_lines(content), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def task_prefix(goal: Column, instruction: Column, output_contract: Column) -> Column:
    """What every condition's input begins with."""
    return F.concat(F.lit("Goal:\n"), goal, F.lit("\n\nReceiver instruction:\n"), instruction, F.lit("\n\nReceiver output contract:\n"), output_contract)


def receiver_input(prefix: Column, context: Column) -> Column:
    """A prefix and a context payload between its marks; the condition is not in it."""
    return F.concat(prefix, F.lit(f"\n\n{BEGIN}\n"), context, F.lit(f"\n{END}"))


def summary_prompt(contract: Contract, prefix: Column, history: Column) -> Column:
    """Asks for a plain summary of a history within the contract's tokens; the receiver's task is quoted, not posed."""
    names = lambda xs: ", ".join(xs) or "none"
    return F.concat(
        F.lit(f"Write a summary of the sender's state for the agent that goes on. Do not do its task.\nKeep the facts it needs and add none. Plain text, {contract.max_tokens} tokens at most.\n\nIts task, quoted as a JSON string:\n"), json_text(prefix),
        F.lit(f"\n\nRequired sections: {names(contract.required)}\nPreferred sections: {names(contract.preferred)}\n\nSender's state:\n"), history,
    )


def goal_context(condition: Column, context: Column, goal: Column) -> Column:
    """The goal once with each condition's context: a packet has it already (null if it is another one), a history or a summary is wrapped."""
    wrap = lambda name, value: F.concat(F.lit('{"goal":'), json_text(goal), F.lit(f',"{name}":'), value, F.lit("}"))
    same = F.get_json_object(context, "$.goal").eqNullSafe(goal)
    return F.when(condition == "packet", F.when(same, context)).when(condition == "full", wrap("sender_state", context)).when(condition == "summary", wrap("summary", json_text(context)))


def public_tasks(tasks: DataFrame, fields: Sequence[str] = PUBLIC) -> DataFrame:
    """The only columns of a task that may enter a request."""
    return tasks.select(*fields)


def indexed_units(units: DataFrame) -> DataFrame:
    """handoff_id, unit_index, source, unit_id, context_indices: units by number, their shared origins by number of first place.

    Rows of ``units``: handoff_id, unit_id, origin, idx, part, context (unit ids).
    """
    from pyspark.sql import Window

    order = [F.col("origin").desc(), F.col("idx"), F.col("part")]  # messages before artifacts
    of = Window.partitionBy("handoff_id")
    told = units.withColumns({"unit_index": F.row_number().over(of.orderBy(*order)) - 1, "source": F.dense_rank().over(of.orderBy(*order[:2])) - 1})
    context = told.select("handoff_id", F.col("unit_index").alias("_u"), F.posexplode("context").alias("_p", "unit_id")).join(told.select("handoff_id", "unit_id", F.col("unit_index").alias("_c")), ["handoff_id", "unit_id"])
    lists = context.groupBy("handoff_id", F.col("_u").alias("unit_index")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_c"))), lambda x: x["_c"]).alias("context_indices"))
    return told.select("handoff_id", "unit_index", "source", "unit_id").join(lists, ["handoff_id", "unit_index"], "left").withColumn("context_indices", F.coalesce("context_indices", F.array().cast("array<int>")))


def indexed_plan(plan: DataFrame, indexed: DataFrame, n_needs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan by unit id, coverage, broken) of a plan by numbers (handoff_id, rank, unit_index, section, essential, needs array<int>).

    ``broken``: handoff_id, code (bad_unit: unknown or repeated; bad_need: outside, or repeated in one selection) of plans that can't be read.
    """
    from pyspark.sql import Window

    named = plan.join(indexed.select("handoff_id", "unit_index", "unit_id"), ["handoff_id", "unit_index"], "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("handoff_id", "unit_index")))
    bad_unit = F.col("unit_id").isNull() | (F.col("_n") > 1)
    bad_need = (F.size("needs") != F.size(F.array_distinct("needs"))) | F.exists("needs", lambda x: (x < 0) | (x >= n_needs))
    broken = named.where(bad_unit | bad_need).groupBy("handoff_id").agg(F.min_by(F.when(bad_unit, "bad_unit").otherwise("bad_need"), "rank").alias("code"))
    fine = named.join(broken, "handoff_id", "left_anti")
    coverage = fine.select("handoff_id", "rank", "unit_id", F.explode("needs").alias("need")).groupBy("handoff_id", "need").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))), lambda x: x["unit_id"]).alias("unit_ids"))
    return fine.select("handoff_id", "rank", "unit_id", "section", "essential"), coverage, broken


def delivery(packets: DataFrame) -> DataFrame:
    """Packets as the one message that a receiver's run or graph state gets: handoff_id, history (JSON array of the item), update (JSON state), goto.

    ``packets``: handoff_id, receiver, text.
    """
    item = F.concat(F.lit('{"role":"user","content":'), json_text(F.col("text")), F.lit("}"))
    return packets.select("handoff_id", F.concat(F.lit("["), item, F.lit("]")).alias("history"), F.concat(F.lit('{"handoff_packet":'), json_text(F.col("text")), F.lit(',"messages":['), item, F.lit("]}")).alias("update"), F.col("receiver").alias("goto"))


def segments(items: DataFrame) -> DataFrame:
    """handoff_id, history, pre_handoff, input: what is left of each segment, rebuilt in its order as a JSON array.

    ``items``: handoff_id, segment, source_index, part, item (JSON), content, was_string. An unknown segment counts as input. A
    history that came as one string goes back as that string, if one message of text is left.
    """
    known = F.when(F.col("segment").isin("history", "pre_handoff"), F.col("segment")).otherwise("input")
    per = items.withColumn("segment", known).groupBy("handoff_id", "segment").agg(F.array_sort(F.collect_list(F.struct("source_index", "part", "item", "content"))).alias("xs"), F.bool_or("was_string").alias("was_string"))
    text = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["item"]), ","), F.lit("]"))
    only = F.get("xs", F.lit(0))["content"]
    body = F.when(F.col("was_string") & (F.size("xs") == 1) & only.isNotNull(), json_text(only)).otherwise(text)
    of = lambda s: F.coalesce(F.max(F.when(F.col("segment") == s, F.col("body"))), F.lit("[]")).alias(s)
    return per.withColumn("body", body).groupBy("handoff_id").agg(of("history"), of("pre_handoff"), of("input"))


def estimate(text: Column) -> Column:
    """Tokens of a payload."""
    return tk.text_tokens(text)
