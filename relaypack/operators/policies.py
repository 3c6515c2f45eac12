"""Policies over messages: protect, select, exact dedup, schema, summary, budget."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions.arrow import arrow_function
from relaypack.functions import tokens as tk
from relaypack.functions.patterns import EXTRACT
from relaypack.operators.frames import Frames, Policy, envelope_sizes
from relaypack.operators.redact import source_key



def _strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _named(policy: Callable[[Frames], Frames], name: str, rank: int) -> Policy:
    policy.name, policy.rank = name, rank
    return policy


# ---- protect


def is_protected(tags: Iterable[str] = ("constraint", "citation", "conclusion"), fields: Iterable[str] = ("constraints", "citations", "conclusions")) -> Column:
    """Tagged, or an object with such a key, or of such a category."""
    keys = F.when(F.col("content_type") == "object", F.json_object_keys("content"))
    return (
        F.arrays_overlap("tags", _strings(tags))
        | F.coalesce(F.arrays_overlap(keys, _strings(fields)), F.lit(False))
        | F.coalesce(F.get_json_object("metadata_json", "$.category").isin(*tags), F.lit(False))
    )


def preserve(tags: Iterable[str] = ("constraint", "citation", "conclusion"), fields: Iterable[str] = ("constraints", "citations", "conclusions")) -> Policy:
    def run(f: Frames) -> Frames:
        m = f.messages.withColumn("_hit", is_protected(tags, fields))
        counts = m.groupBy("handoff_id").agg(F.count_if(F.col("_hit") & ~F.col("protected")).alias("count"))
        return f.with_(messages=m.withColumn("protected", F.col("protected") | F.col("_hit")).drop("_hit")).event("preserve", "protected", counts)

    return _named(run, "preserve", 10)


# ---- select


def selected(roles: Iterable[str] | None = None, kinds: Iterable[str] | None = None, tags: Iterable[str] | None = None) -> Column:
    """All given criteria hold, each by any of its values; protected rows are always selected."""
    ok: Column = F.lit(True)
    if roles:
        ok = ok & F.col("role").isin(*roles)
    if kinds:
        ok = ok & F.col("kind").isin(*kinds)
    if tags:
        ok = ok & F.arrays_overlap("tags", _strings(tags))
    return F.col("protected") | ok


def select(roles: Iterable[str] | None = None, kinds: Iterable[str] | None = None, tags: Iterable[str] | None = None) -> Policy:
    ok = (list(roles or ()), list(kinds or ()), list(tags or ()))

    def run(f: Frames) -> Frames:
        m = f.messages.withColumn("_ok", selected(*ok))
        return f.with_(messages=m.where("_ok").drop("_ok")).event("select", "selected", m.groupBy("handoff_id").agg(F.count_if(~F.col("_ok")).alias("count")))

    return _named(run, "select", 40)


# ---- exact dedup


def dedup_marks(messages: DataFrame) -> DataFrame:
    """Adds ``dup``: a later equal unprotected message. Protected ones neither go nor make others go."""
    key = F.coalesce(F.col("src_key"), source_key())
    w = Window.partitionBy("handoff_id", "protected", "_key").orderBy("msg_idx")
    return messages.withColumn("_key", key).withColumn("dup", ~F.col("protected") & (F.row_number().over(w) > 1)).drop("_key")


def deduplicate() -> Policy:
    def run(f: Frames) -> Frames:
        m = dedup_marks(f.messages)
        counts = m.groupBy("handoff_id").agg(F.count_if("dup").alias("count"))
        return f.with_(messages=m.where("not dup").drop("dup").withColumn("src_key", F.lit(None).cast("string"))).event("deduplicate", "duplicates_removed", counts)

    return _named(run, "deduplicate", 30)


def distinct_in_order(rows: DataFrame, key: list[str | Column], place: str) -> DataFrame:
    """First of equal rows by place."""
    w = Window.partitionBy(*key).orderBy(place)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# ---- schema


def required_fields(fields: Iterable[str], kinds: Iterable[str] = ("structured",), *, normalize: bool = True) -> Policy:
    """Objects of these kinds must have the fields; other keys go when normalizing. One that fails denies its handoff."""
    fields, kinds = list(fields), list(kinds)

    def run(f: Frames) -> Frames:
        m = f.messages
        mine = F.col("kind").isin(*kinds)
        keys = F.when(F.col("content_type") == "object", F.json_object_keys("content"))
        m = m.withColumn("_keys", F.when(mine, keys)).withColumn("_bad", mine & (F.col("_keys").isNull() | (F.size(F.array_except(_strings(fields), F.col("_keys"))) > 0)))
        removed = F.when(mine & ~F.col("_bad"), F.size(F.array_except("_keys", _strings(fields)))).otherwise(0)
        counts = m.where(mine).groupBy("handoff_id").agg(F.count(F.lit(1)).alias("count"), F.sum(removed).alias("removed"), F.count_if(removed > 0).alias("changed"))
        details = F.create_map(F.lit("normalized_messages"), F.col("changed").cast("string"), F.lit("removed_fields"), F.col("removed").cast("string"))
        f = f.event("schema", "validated", counts.withColumn("details", details) if normalize else counts)
        bad = m.where("_bad")
        if normalize:
            m = m.withColumn("content", F.when(mine, keep_keys(F.col("content"), fields)).otherwise(F.col("content")))
        return f.with_(messages=m.drop("_keys", "_bad")).deny("schema", "validation", bad)

    return _named(run, "schema", 25)


def typed(ddl: str, kinds: Iterable[str] = ("structured",), *, normalize: bool = True) -> Policy:
    """Objects of these kinds must have the fields of a schema (DDL; NOT NULL: required) in their types; other keys go when normalizing.

    A field of another type, or a required one that isn't there, denies the handoff.
    """
    from pyspark.sql.types import StructType

    kinds, shape = list(kinds), StructType.fromDDL(ddl)

    def run(f: Frames) -> Frames:
        mine = F.col("kind").isin(*kinds)
        keys = F.when(F.col("content_type") == "object", F.json_object_keys("content"))
        held = F.from_json("content", "map<string,variant>")
        wrong = keys.isNull()
        for x in shape.fields:
            value = F.try_element_at(held, F.lit(x.name))
            name = x.dataType.simpleString()
            told = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            right = {"string": told == "STRING", "boolean": told == "BOOLEAN", "bigint": told == "BIGINT", "int": told == "BIGINT", "double": told.rlike("^(BIGINT|DOUBLE|DECIMAL)")}.get(name, told.rlike("^ARRAY") if name.startswith("array") else told.rlike("^OBJECT"))
            wrong = wrong | F.when(told == "VOID", not x.nullable).otherwise(~right)
        m = f.messages.withColumn("_keys", F.when(mine, keys)).withColumn("_bad", mine & F.coalesce(wrong, F.lit(True)))
        f = f.event("schema", "validated", m.where(mine).groupBy("handoff_id").agg(F.count(F.lit(1)).alias("count")))
        bad = m.where("_bad")
        if normalize:
            m = m.withColumn("content", F.when(mine, keep_keys(F.col("content"), shape.names)).otherwise(F.col("content")))
        return f.with_(messages=m.drop("_keys", "_bad")).deny("schema", "validation", bad)

    return _named(run, "schema", 25)


def keep_keys(content: Column, fields: list[str]) -> Column:
    """A JSON object with these keys only, in the order of the fields; values stay as they are written."""
    held = F.from_json(content, "map<string,string>")
    typed = F.from_json(content, "map<string,variant>")
    parts = []
    for f in fields:
        value = F.element_at(typed, f)
        # a box keeps the order of its keys as text
        text = F.when(F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)"), F.element_at(held, f)).otherwise(F.to_json(value))
        parts.append(F.when(F.map_contains_key(held, f), F.concat(F.lit(json.dumps(f) + ":"), text)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


@arrow_function("changed bigint, removed bigint")
def structural_diff(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Nodes that differ and keys that went, over whole JSON trees."""

    def walk(a, b) -> tuple[int, int]:
        if isinstance(a, dict) and isinstance(b, dict):
            sub = [walk(a[k], b[k]) for k in a if k in b]
            added = sum(k not in a for k in b)
            return sum(x for x, _ in sub) + added, sum(y for _, y in sub) + sum(k not in b for k in a)
        if isinstance(a, list) and isinstance(b, list):
            sub = [walk(x, y) for x, y in zip(a, b, strict=False)]
            return sum(x for x, _ in sub) + abs(len(a) - len(b)), sum(y for _, y in sub)
        return int(type(a) is not type(b) or a != b), 0

    return pd.DataFrame([walk(json.loads(a), json.loads(b)) if a is not None and b is not None else (0, 0) for a, b in zip(before, after, strict=True)], columns=["changed", "removed"])


# ---- summary


def extract_summary(text: str, max_tokens: int) -> str:
    """The offline summarizer: a mark and the text, shortened by tenths until it fits."""
    size = lambda s: max(1, math.ceil(len(s.encode()) / 4)) if s else 0
    out = EXTRACT + text
    while out and size(out) > max_tokens:
        out = out[: len(out) - max(1, len(out) // 10)]
    return out


def summarize(max_tokens: int, summarizer: Callable[[str, int], str] = extract_summary, *, name: str = "summarize") -> Policy:
    """Unprotected messages of a handoff become one of kind ``summary`` at the first one's place.

    A summary above the limit denies the handoff. Handoffs without unprotected rows are skipped.
    """

    @F.pandas_udf("string")
    def run_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: summarizer(t, max_tokens))

    def run(f: Frames) -> Frames:
        free = f.messages.where("not protected")
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "content"))), lambda x: x["content"]), "\n")
        one = free.groupBy("handoff_id").agg(F.min("msg_idx").alias("msg_idx"), F.count(F.lit(1)).alias("n"), ordered.alias("_t"), F.sum(tk.tokens(F.octet_length("content"))).alias("_in"))
        one = one.withColumn("content", run_all("_t")).withColumn("_out", tk.text_tokens(F.col("content")))
        bad = one.where((F.col("_out") > max_tokens) | (F.length(F.trim("content")) == 0))
        details = F.create_map(F.lit("input_tokens"), F.col("_in").cast("string"), F.lit("output_tokens"), F.col("_out").cast("string"))
        f = f.event(name, "summarized", one.select("handoff_id", (F.col("n") - 1).alias("count"), details.alias("details")))
        row = one.select(
            "handoff_id", "msg_idx", F.lit("assistant").alias("role"), F.lit("text").alias("content_type"), "content", F.lit("summary").alias("kind"), F.array(F.lit("summary")).alias("tags"),
            F.lit("{}").alias("metadata_json"), F.lit(False).alias("protected"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("src_key"),
        )
        return f.with_(messages=f.messages.where("protected").unionByName(row)).deny(name, "summarization", bad)

    return _named(run, name, 40)


# ---- budget


def budget_marks(f: Frames, max_tokens: int, strategy: str = "drop_oldest") -> DataFrame:
    """Messages with ``dropped``: the fewest unprotected ones, oldest or largest first, until the envelope fits.

    One sum over each handoff's removable rows in their order tells for each row what is left when those before it are gone:
    a row goes exactly if that still doesn't fit. No row is looked at twice.
    """
    limit = 4 * (max_tokens - 4)  # tokens <= max: bytes <= limit
    size = tk.message_bytes(wide=True)
    sizes = envelope_sizes(f).select("handoff_id", "bytes", "n_messages")
    m = f.messages.withColumn("_b", size).join(sizes, "handoff_id")
    order = ["msg_idx"] if strategy == "drop_oldest" else [F.desc(tk.message_tokens(F.col("_b"))), "msg_idx"]
    w = Window.partitionBy("handoff_id", "protected").orderBy(*order)
    before = F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_b")
    gone = F.row_number().over(w) - 1
    left = F.col("bytes") - before - 2 * (tk.separators(F.col("n_messages")) - tk.separators(F.col("n_messages") - gone))
    return m.withColumn("dropped", ~F.col("protected") & (left > limit)).drop("_b", "bytes", "n_messages")


def budget(max_tokens: int, strategy: str = "drop_oldest") -> Policy:
    if max_tokens <= 0 or strategy not in ("drop_oldest", "drop_largest", "error"):
        raise ValueError("bad budget")

    def run(f: Frames) -> Frames:
        if strategy == "error":
            over = envelope_sizes(f).where(F.col("tokens") > max_tokens)
            return f.event("budget", "within_budget", envelope_sizes(f).where(F.col("tokens") <= max_tokens).select("handoff_id", F.lit(0).alias("count"))).deny("budget", "budget_exceeded", over)
        m = budget_marks(f, max_tokens, strategy)
        counts = m.groupBy("handoff_id").agg(F.count_if("dropped").alias("count"))
        out = f.with_(messages=m.where("not dropped").drop("dropped"))
        over = envelope_sizes(out).where(F.col("tokens") > max_tokens)
        return out.event("budget", "trimmed", counts.where("count > 0")).event("budget", "within_budget", counts.where("count = 0")).deny("budget", "budget_exceeded", over)

    return _named(run, "budget", 50)
