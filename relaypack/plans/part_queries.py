"""Queries: single steps of scans, redaction, normalization, spans and reports, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaypack.functions.text import snake_code, strip
from relaypack.operators import normalize, packets, policies, redact, selection, spans, state, tools
from relaypack.operators import records as rc
from relaypack.operators.frames import frames, text_messages
from relaypack.plans.common import conversation_frames, conversation_messages, table
from relaypack.plans.text_queries import Query
from relaypack.sources import scans, sinks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _talk(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *columns)


def _heads(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json").distinct()


# ---- scans

_ITEM = """case turn % 3 when 0 then concat('{"role":"', role, '","content":"x","tags":["b","a"]}') when 1 then concat('{"role":"', role, '","content":{"k":[1,2]},"kind":"note"}') else concat('{"role":"', role, '","content":"y","metadata":{"n":', turn, '}}') end as item"""


@query("""select conv_id, turn, role, case turn % 3 when 1 then 'object' else 'text' end as content_type, case turn % 3 when 0 then 'x' when 1 then '{"k":[1,2]}' else 'y' end as content, case turn % 3 when 1 then 'note' else 'message' end as kind, case turn % 3 when 0 then 2 else 0 end as n_tags, case turn % 3 when 2 then '{"n":' || turn || '}' else '{}' end as metadata_json from conversations""")
def message_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages with and without their optional fields."""
    rows = _talk(spark, sf_dir, "role", _ITEM).select(F.col("conv_id").alias("handoff_id"), F.col("turn").alias("msg_idx"), "item")
    m = scans.message_items(rows)
    return m.select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"), "role", "content_type", "content", "kind", F.size("tags").alias("n_tags"), "metadata_json")


@query("select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, turn::varchar as item from conversations")
def segment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, items before the handoff, then new items: one sequence; the model's input is not given."""
    of = lambda lo, hi: F.transform(F.filter(F.array_sort(F.collect_list("turn")), lambda t: (t >= lo) & (t < hi)), lambda t: t.cast("string"))
    s = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("handoff_id")).agg(of(0, 2).alias("history"), of(2, 4).alias("pre_items"), of(4, 1 << 30).alias("new_items")).withColumn("input_items", F.lit(None).cast("array<string>"))
    return scans.snapshot_items(s).select(F.col("handoff_id").alias("conv_id"), "pos", "item")


_DOC_LINES = "select 'd' || doc_id || '.txt' as path, unnest(ls) as line, generate_subscripts(ls, 1)::int as line_no from (select doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') as ls from documents where doc_id is not null)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.posexplode(F.split("text", "\r\n|\n|\r")).alias("i", "line"))
    return d.select("path", (F.col("i") + 1).alias("line_no"), "line")


@query(f"select path, line_no, substring(line, 1, 400) as line from ({_DOC_LINES}) where contains(lower(line), 'license') order by path, line_no limit 80")
def repository_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits of a word among all documents' lines; a report."""
    return scans.search(_lines(spark, sf_dir), "LICENSE")


@query(f"select path from ({_DOC_LINES}) where path like 'd1%' group by path order by path limit 250")
def repository_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paths(_lines(spark, sf_dir), "d1")


@query("select doc_id, md5(case when strlen(text) <= 100 then text else decode(unhex(regexp_replace(hex(encode(text))[-200:], '^(?:[89AB][0-9A-F]){1,3}', ''))) end) as tail from documents where text is not null")
def bounded_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 100 bytes of every document, in whole characters."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(scans.tail(F.col("text"), 100)).alias("tail"))


# ---- redaction, schema


@query("""select conv_id, turn, '{"to":["[REDACTED:email]",' || turn || '],"deep":{"x":{"y":"[REDACTED:email]"}},"n":1}' as content from conversations""")
def redact_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in nested values."""
    c = _talk(spark, sf_dir, """concat('{"to":["a@b.org",', turn, '],"deep":{"x":{"y":"c', turn, '@d.org"}},"n":1}') as t""").withColumnRenamed("conv_id", "handoff_id")
    m = text_messages(c, F.col("handoff_id"), F.col("turn"), F.lit("user"), F.col("t")).withColumn("content_type", F.lit("object"))
    f = redact.redact(["email"])(frames(spark, _heads(c), m, nested=True))
    return f.messages.select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"), "content")


@query("select conv_id, 'redaction' as code from conversations group by conv_id having sum(strlen(role) + 7 + strlen(text) + 2) + 16 > 3000 or count(*) * 3 + 2 > 20")
def redaction_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with more to scan than allowed are denied: 3,000 bytes, 20 texts."""
    f = redact.redact(["email"], max_scan_bytes=3000, max_scan_strings=20)(conversation_frames(spark, sf_dir))
    return f.denials.select(F.col("handoff_id").alias("conv_id"), "code")


@query("select conv_id, turn, (1 + (turn % 2 = 0)::int + 1)::bigint as changed, (1 + (turn % 2 = 1)::int)::bigint as removed from conversations")
def structural_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that differ and keys that went, of two trees."""
    before = F.concat(F.lit('{"a":1,"b":{"c":[1,2,3],"gone":1},"d":'), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 1, ',"z":1').otherwise(""), F.lit("}"))
    after = F.concat(F.lit('{"a":2,"b":{"c":[1,9,3]},"d":'), F.when(F.col("turn") % 2 == 0, F.lit('"x"')).otherwise(F.col("turn").cast("string")), F.lit("}"))
    return _talk(spark, sf_dir).withColumn("x", policies.structural_diff(before, after)).select("conv_id", "turn", "x.changed", "x.removed")


# ---- state, normalization


@query("""select conv_id, turn, turn % 5 in (1, 2, 3) as bad from conversations""")
def metadata_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task ids that are no strings, or blank ones."""
    meta = """case turn % 5 when 0 then '{}' when 1 then '{"task_id":7}' when 2 then '{"task_id":"  "}' when 3 then '{"task_id":null}' else '{"task_id":"t"}' end as metadata_json"""
    return _talk(spark, sf_dir, meta).select("conv_id", "turn", state.bad_metadata("task_id").alias("bad"))


@query("""select conv_id, turn, case turn % 4 when 0 then 'decisions' when 1 then 'evidence' when 2 then 'tool_results' end as section, case turn % 4 when 0 then 'explicit_kind_or_tag' when 1 then 'metadata_hint' when 2 then 'tool_role_or_kind' end as rule from conversations""")
def classification_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule names a message's section: its kind, a hint, a tool's role, or none."""
    c = _talk(spark, sf_dir, "case turn % 4 when 2 then 'tool' else 'user' end as role", "case turn % 4 when 0 then 'decisions' else 'message' end as kind", """case turn % 4 when 1 then '{"handoff_section":"evidence"}' else '{}' end as meta""")
    m = text_messages(c, F.col("conv_id"), F.col("turn"), F.col("role"), F.lit("plain words"), kind=F.col("kind"), metadata_json=F.col("meta"))
    return normalize.normalize(m).select(F.col("handoff_id").alias("conv_id"), F.col("source_idx").cast("long").alias("turn"), "section", "rule")


@query("select doc_id, md5(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g')) as digest from (select doc_id, '  ' || chr(160) || text || chr(10) || chr(8195) as text from documents)")
def stripped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(strip(F.concat(F.lit("   "), F.col("text"), F.lit("\n ")))).alias("digest"))


@query("select conv_id, turn, case turn % 3 when 0 then 'budget_exceeded' when 1 then 'contract' else 'handoff_integrity' end as code from conversations")
def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of exceptions as codes."""
    c = _talk(spark, sf_dir, "case turn % 3 when 0 then 'BudgetExceededError' when 1 then 'ContractError' else 'HandoffIntegrityError' end as name")
    return c.select("conv_id", "turn", snake_code(F.col("name")).alias("code"))


@query("select conv_id, turn, case turn % 3 when 0 then '' when 1 then '[Proposed] ' else '[Unverified] ' end || role as content from conversations")
def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _talk(spark, sf_dir, "case turn % 3 when 0 then 'observed' when 1 then 'proposed' else 'uncertain' end as status", "role as content")
    return c.select("conv_id", "turn", selection.brief_text().alias("content"))


@query("select conv_id, turn, length(text) % 4 = 0 as strict from conversations")
def strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON without repeated keys and without NaN."""
    c = _talk(spark, sf_dir, """case length(text) % 4 when 0 then '{"a":1}' when 1 then '{"a":1,"a":2}' when 2 then '[NaN]' else '{"a":' end as t""")
    return c.select("conv_id", "turn", rc.strict_json("t").alias("strict"))


# ---- tools, packets, spans


@query("select conv_id from conversations group by conv_id having count(*) filter (length(text) % 10 = 0) > 0")
def changed_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that lost a control row."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("handoff_id"), F.concat_ws("|", "role", F.col("turn").cast("string")).alias("descriptor"), (F.length("text") % 10 == 0).alias("lost"))
    return tools.same_multiset(c, c.where("not lost")).select(F.col("handoff_id").alias("conv_id"))


@query("select conv_id from (select distinct conv_id from conversations) where conv_id % 3 = 0")
def continued_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that go on with another agent than the one they were for."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("handoff_id")).distinct()
    heads = c.select("handoff_id", F.lit("s").alias("sender"), F.concat(F.lit("r"), (F.col("handoff_id") % 3).cast("string")).alias("receiver"), F.lit("g").alias("goal"))
    texts = packets.render(heads, spark.createDataFrame([], "handoff_id bigint, section string, pos bigint, item string"))
    now = c.select("handoff_id", F.concat(F.lit("r"), F.greatest(F.col("handoff_id") % 3, F.lit(1)).cast("string")).alias("sender"))
    return packets.wrong_receiver(texts, now).select(F.col("handoff_id").alias("conv_id"))


_LINES = "select conv_id, turn, line, k, sum(length(line) + (k < n)::int) over (partition by conv_id, turn order by k) as stop, length(line) + (k < n)::int as size from (select conv_id, turn, unnest(ls) as line, generate_subscripts(ls, 1) as k, len(ls) as n from (select conv_id, turn, string_split(text, chr(10)) as ls from conversations))"


@query(f"select conv_id, turn, (row_number() over w - 1)::int as part, (stop - size - lag(stop) over w)::bigint as gap from ({_LINES}) where trim(line, E' \\t') <> '' window w as (partition by conv_id, turn order by k)")
def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters between the spans of a message."""
    g = spans.gaps(spans.source_units(conversation_frames(spark, sf_dir)))
    return g.select(F.col("handoff_id").alias("conv_id"), F.col("idx").cast("long").alias("turn"), "part", F.col("gap").cast("long").alias("gap"))


@query("select conv_id, turn from conversations where role <> 'system' and length(text) % 3 > 0")
def nonblank_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talk(spark, sf_dir, "role", "case when role = 'system' then '' when length(text) % 3 = 0 then ' \t\n' else text end as content")
    return spans.nonblank(rows, "content").select("conv_id", "turn")


@query("select conv_id, list(turn::int order by turn) as turns from conversations where length(text) % 2 = 0 group by conv_id")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units ranked by length, put back into the order of their source."""
    c = _talk(spark, sf_dir, "length(text) as n").where("n % 2 = 0")
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "turn")))
    return ranked.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "rank"))), lambda x: x["turn"].cast("int")).alias("turns"))


@query("select conv_id, turn from conversations")
def public_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a frame takes from rows that pretend to be protected or classified."""
    m = conversation_messages(spark, sf_dir).withColumns({"protected": F.lit(True), "section": F.lit("decisions"), "src_key": F.lit("forged")})
    f = frames(spark, _heads(m), m)
    return f.messages.where("not protected and section is null and src_key is null").select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"))


@query("""select conv_id, 's -> r' || chr(10) || 'handoff: ' || conv_id || chr(10) || 'status: passed' || chr(10) || 'original tokens (estimated): ' || n || chr(10) || 'transmitted tokens (estimated): 7' || chr(10) || 'estimated savings: 12.5%' || chr(10) || 'redactions: 0' || chr(10) || 'duplicates removed: 1' || chr(10) || 'protected messages: 2' as text from (select conv_id, count(*) as n from conversations group by conv_id)""")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("original_tokens"))
    r = n.selectExpr("conv_id", "conv_id as handoff_id", "'s' as sender", "'r' as receiver", "'passed' as status", "original_tokens", "7 as transmitted_tokens", "12.5D as saved_percent", "0 as redactions", "1 as duplicates_removed", "2 as protected_messages", "cast(null as string) as failure_code")
    return r.select("conv_id", sinks.report_text().alias("text"))


@query("""select conv_id, 'packet tokens: ' || n || ' of 100, ' || (100 - n) || ' left' || chr(10) || 'required tokens: 5' || chr(10) || 'omitted: decisions=1, evidence=' || n as text from (select conv_id, count(*) as n from conversations group by conv_id)""")
def budget_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    r = n.select("conv_id", F.col("n").alias("packet_tokens"), F.lit(100).alias("max_tokens"), (100 - F.col("n")).alias("remaining_tokens"), F.lit(5).alias("required_tokens"), F.create_map(F.lit("evidence"), "n", F.lit("decisions"), F.lit(1).cast("long")).alias("omitted_before"))
    return r.select("conv_id", sinks.budget_text().alias("text"))
