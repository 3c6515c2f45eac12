"""Scans: handoff JSON, message items, agent snapshots, packets, pinned Parquet, result files, repositories."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.functions.arrow import arrow_function
from relaypack import schema
from relaypack.operators import tools
from relaypack.operators.packets import decode, is_packet

_EMPTY = "array<string>"


@arrow_function("string")
def compact(texts: pd.Series) -> pd.Series:
    """JSON text without spaces, keys in their order."""
    return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":")) if t is not None else None)


def kind_of(v: Column) -> Column:
    """text, object, array or other, of JSON text."""
    first = F.substring(F.ltrim(v), 1, 1)
    return F.when(first == '"', "text").when(first == "{", "object").when(first == "[", "array").otherwise("other")


def message_items(rows: DataFrame, *, handoff: str = "handoff_id", place: str = "msg_idx", item: str = "item") -> DataFrame:
    """Messages of JSON items (texts or objects), with ``failure`` (reserved_field, validation or null).

    A JSON string is a user's message. An object without ``content`` becomes one of kind ``structured`` with all of it as its
    content. Reserved fields and unknown ones deny.
    """
    v = F.col(item)
    keys = F.coalesce(F.json_object_keys(v), F.array().cast(_EMPTY))
    has = lambda k: F.array_contains(keys, k)
    kind = kind_of(v)
    reserved = F.arrays_overlap(keys, F.array(*map(F.lit, schema.RESERVED_FIELDS)))
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, schema.MESSAGE_FIELDS)))) > 0
    parsed = F.from_json(v, "content variant, role string, kind string, tags array<string>, metadata variant")
    raw = F.to_json(parsed["content"])
    content_kind = F.when(kind == "text", "text").when(~has("content"), "object").otherwise(kind_of(raw))
    text = F.when(kind == "text", F.get_json_object(F.concat(F.lit('{"t":'), v, F.lit("}")), "$.t"))
    content = F.when(kind == "text", text).when(~has("content"), compact(F.when(kind == "object", v))).when(content_kind == "text", F.get_json_object(v, "$.content")).otherwise(raw)
    failure = F.when(reserved, "reserved_field").when(kind.isin("array", "other") | (has("content") & (unknown | (content_kind == "other"))), "validation")
    whole = ~has("content") & (kind == "object")
    return rows.select(
        F.col(handoff).cast("long").alias("handoff_id"), F.col(place).cast("int").alias("msg_idx"), F.when(whole, "user").otherwise(F.coalesce(parsed["role"], F.lit("user"))).alias("role"),
        content_kind.alias("content_type"), content.alias("content"), F.when(whole, "structured").otherwise(F.coalesce(parsed["kind"], F.lit("message"))).alias("kind"),
        F.when(whole, F.array().cast(_EMPTY)).otherwise(F.array_sort(F.array_distinct(F.coalesce(parsed["tags"], F.array().cast(_EMPTY))))).alias("tags"),
        F.when(whole, "{}").otherwise(F.coalesce(F.to_json(parsed["metadata"]), F.lit("{}"))).alias("metadata_json"), failure.alias("failure"),
    )


def envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(handoffs, messages, artifacts) of a JSON-lines file of envelopes; a line that isn't one raises."""
    shape = "handoff_id bigint, sender string, receiver string, metadata variant, messages array<variant>, artifacts array<struct<name:string,content:variant,media_type:string,metadata:variant>>"
    raw = spark.read.schema(shape).option("mode", "FAILFAST").json(path)
    heads = raw.select("handoff_id", "sender", "receiver", F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("metadata_json"))
    items = raw.select("handoff_id", F.posexplode("messages").alias("msg_idx", "v")).select("handoff_id", "msg_idx", F.to_json("v").alias("item"))
    a = raw.select("handoff_id", F.posexplode("artifacts").alias("art_idx", "a"))
    content = F.to_json("a.content")
    arts = a.select("handoff_id", "art_idx", "a.name", F.coalesce("a.media_type", F.lit("text/plain")).alias("media_type"), kind_of(content).alias("content_type"), F.when(kind_of(content) == "text", F.expr("variant_get(a.content, '$', 'string')")).otherwise(content).alias("content"), F.coalesce(F.to_json("a.metadata"), F.lit("{}")).alias("metadata_json"))
    return heads, message_items(items), arts


def snapshot_items(snapshots: DataFrame) -> DataFrame:
    """handoff_id, pos, item of snapshots (handoff_id, history, pre_items, input_items, new_items: arrays of JSON texts).

    History, then items before the handoff, then the model's input where it is given, else the new items. Routing items go.
    """
    none = F.array().cast(_EMPTY)
    every = F.concat(F.coalesce("history", none), F.coalesce("pre_items", none), F.coalesce("input_items", "new_items", none))
    rows = snapshots.select("handoff_id", F.posexplode(every).alias("pos", "item"))
    return rows.where(~F.coalesce(F.get_json_object("item", "$.type").isin("handoff_call", "handoff_output"), F.lit(False)))


def snapshot_messages(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, failures) of snapshot items: texts stay, call and output become one tool result, anything else denies."""
    get = lambda p: F.get_json_object("item", p)
    x = items.withColumns({"type": F.coalesce(get("$.type"), F.lit("message")), "call_id": get("$.call_id"), "is_text": kind_of(F.col("item")) == "text"})
    x = x.withColumn("is_call", F.when(F.col("type") == "function_call", True).when(F.col("type") == "function_call_output", False))
    blocks = F.from_json(get("$.content"), "array<struct<type:string,text:string>>")
    listed = F.substring(F.ltrim(F.coalesce(get("$.content"), F.lit(""))), 1, 1) == "["
    good = F.forall(blocks, lambda b: b["type"].isin("input_text", "output_text") & b["text"].isNotNull())
    other = ~F.col("type").isin("message", "function_call", "function_call_output", "reasoning") | (F.col("type") == "message") & listed & ~F.coalesce(good, F.lit(False))
    failed = x.where(other & ~F.col("is_text")).select("handoff_id", F.lit("unsupported_adapter_mode").alias("code")).distinct()
    failed = failed.unionByName(tools.validate(x.select("handoff_id", "pos", "call_id", "is_call")).select("handoff_id", F.lit("handoff_integrity").alias("code"))).groupBy("handoff_id").agg(F.min("code").alias("code"))
    text = F.when(F.col("is_text"), F.get_json_object(F.concat(F.lit('{"t":'), F.col("item"), F.lit("}")), "$.t")).when(listed, F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")).otherwise(F.coalesce(get("$.content"), F.lit("")))
    none = F.array().cast(_EMPTY)
    plain = x.where(F.col("is_text") | (F.col("type") == "message")).select("handoff_id", F.col("pos").alias("msg_idx"), F.coalesce(get("$.role"), F.lit("user")).alias("role"), F.lit("text").alias("content_type"), text.alias("content"), F.lit("message").alias("kind"), none.alias("tags"), F.lit("{}").alias("metadata_json"))
    calls = x.where("is_call is not null").groupBy("handoff_id", "call_id").agg(
        F.max(F.when(~F.col("is_call"), F.col("pos"))).alias("msg_idx"), F.max(F.when(F.col("is_call"), get("$.name"))).alias("name"),
        F.max(F.when(F.col("is_call"), get("$.arguments"))).alias("arguments"), F.max(F.when(~F.col("is_call"), get("$.output"))).alias("output"),
    ).where("msg_idx is not null")
    results = calls.select("handoff_id", "msg_idx", F.lit("tool").alias("role"), F.lit("object").alias("content_type"), tools.result_content(F.col("call_id"), F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), F.coalesce("output", F.lit(""))).alias("content"), F.lit("tool_results").alias("kind"), none.alias("tags"), F.lit("{}").alias("metadata_json"))
    return plain.unionByName(results).join(failed, "handoff_id", "left_anti"), failed


#: Role names of chat graphs.
GRAPH_ROLES = {"human": "user", "ai": "assistant", "function": "tool", "tool": "tool", "system": "system", "user": "user", "assistant": "assistant"}


def graph_messages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, failures) of a chat graph's state (handoff_id, pos, item: JSON with type or role, content, tool_calls, tool_call_id).

    A call and its result become one tool result at the result's place. Orphaned, repeated and unfinished calls deny, and so
    does any other message while calls wait.
    """
    get = lambda p: F.get_json_object("item", p)
    role = F.element_at(F.create_map(*(F.lit(x) for p in GRAPH_ROLES.items() for x in p)), F.coalesce(get("$.type"), get("$.role"), F.lit("human")))
    x = rows.withColumn("role", role)
    calls = F.from_json(get("$.tool_calls"), "array<struct<id:string,name:string,args:variant>>")
    wide = x.select("handoff_id", F.col("pos"), "role", "item", F.posexplode_outer(calls).alias("k", "c"))
    # places: a message's text, then its calls
    events = wide.where("c is not null").select("handoff_id", (F.col("pos") * 1000 + F.col("k") + 1).alias("pos"), F.col("c.id").alias("call_id"), F.lit(True).alias("is_call"), F.col("c.name").alias("name"), F.to_json("c.args").alias("arguments"), F.lit(None).cast("string").alias("output"))
    outs = x.where("role = 'tool'").select("handoff_id", (F.col("pos") * 1000).alias("pos"), get("$.tool_call_id").alias("call_id"), F.lit(False).alias("is_call"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), get("$.content").alias("output"))
    texts = x.where("role <> 'tool'").select("handoff_id", (F.col("pos") * 1000).alias("pos"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("is_call"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), get("$.content").alias("output"))
    failed = tools.validate(events.unionByName(outs).unionByName(texts), strict_order=True).select("handoff_id", F.lit("handoff_integrity").alias("code"))
    none = F.array().cast(_EMPTY)
    plain = x.where("role <> 'tool'").where(F.length(F.coalesce(get("$.content"), F.lit(""))) > 0).select("handoff_id", (F.col("pos") * 1000).cast("int").alias("msg_idx"), "role", F.lit("text").alias("content_type"), get("$.content").alias("content"), F.lit("message").alias("kind"), none.alias("tags"), F.lit("{}").alias("metadata_json"))
    both = events.unionByName(outs).groupBy("handoff_id", "call_id").agg(F.max(F.when(~F.col("is_call"), F.col("pos"))).alias("p"), F.max("name").alias("name"), F.max("arguments").alias("arguments"), F.max("output").alias("output")).where("p is not null")
    results = both.select("handoff_id", F.col("p").cast("int").alias("msg_idx"), F.lit("tool").alias("role"), F.lit("object").alias("content_type"), tools.result_content(F.col("call_id"), F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), F.coalesce("output", F.lit(""))).alias("content"), F.lit("tool_results").alias("kind"), none.alias("tags"), F.lit("{}").alias("metadata_json"))
    return plain.unionByName(results).join(failed, "handoff_id", "left_anti"), failed


def expand_packets(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary messages, packet items): a user's text that is a packet is read as one."""
    mine = (F.col("role") == "user") & (F.col("content_type") == "text") & is_packet(F.col("content"))
    return messages.where(~mine), decode(messages.where(mine).select("handoff_id", F.col("content").alias("receiver_text")))


def pinned_parquet(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A Parquet file whose bytes have this digest; any other raises before it is read."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if got is None or got[0] != sha256:
        raise ValueError(f"{path} isn't the pinned file")
    return spark.read.parquet(path)


def result_runs(spark: SparkSession, path: str, n_rows: int = 3) -> DataFrame:
    """file, complete: whether a JSON-lines run has one header, so many observations and one footer."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.get_json_object("value", "$.record_type").alias("kind"))
    return rows.groupBy("file").agg((F.count_if(F.col("kind") == "header") == 1).alias("h"), (F.count_if(F.col("kind") == "footer") == 1).alias("f"), (F.count_if(F.col("kind") == "observation") == n_rows).alias("n"), F.count(F.lit(1)).alias("rows")).select("file", (F.col("h") & F.col("f") & F.col("n") & (F.col("rows") == n_rows + 2)).alias("complete"))


def repository_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of the text files below a folder."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def search(lines: DataFrame, needle: str, *, limit: int = 80, width: int = 400) -> DataFrame:
    """The first hits by path and line, case folded; a report, so it has a limit."""
    hit = lines.where(F.contains(F.lower("line"), F.lit(needle.lower())))
    return hit.orderBy("path", "line_no").limit(limit).select("path", "line_no", F.substring("line", 1, width).alias("line"))


def read_range(lines: DataFrame, path: str, first: int, last: int) -> DataFrame:
    return lines.where((F.col("path") == path) & F.col("line_no").between(first, last))


def paths(lines: DataFrame, prefix: str = "", *, limit: int = 250) -> DataFrame:
    return lines.where(F.startswith(F.col("path"), F.lit(prefix))).select("path").distinct().orderBy("path").limit(limit)


def tail(text, most: int = 16_000):
    """The last bytes of a text, ``most`` at most, from the beginning of a character on."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, F.greatest(F.octet_length(text) - most + 1, F.lit(1)), F.lit(most))
    # a character that was cut leaves up to three bytes of its rest
    whole = F.regexp_replace(F.hex(cut), "^(?:[89AB][0-9A-F]){1,3}", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))
