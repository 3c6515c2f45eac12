"""Queries: routes, state, classification, splitting, contracts, budgets of packets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.functions import classify as cl
from relaypack.functions import tokens as tk
from relaypack.functions.patterns import KEY_SECTIONS, TEXT_LABELS
from relaypack.operators import compiler, normalize, packets, state, tools
from relaypack.operators.fit import fit, fit_stream
from relaypack.operators.frames import frames, text_messages
from relaypack.operators.redact import redact
from relaypack.operators.routes import Rule, resolve, rules_table
from relaypack.plans.common import conversation_frames, conversation_messages, table, values
from relaypack.plans.text_queries import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Small cases on written-down rows, for the tests; the queries of their names run over tables.
CASES: dict[str, Query] = {}
CASE_SQL: dict[str, str] = {}


def case(sql: str):
    def add(f: Query) -> Query:
        CASES[f.__name__] = f
        CASE_SQL[f.__name__] = sql
        return f

    return add


# ---- the greedy fit

_FOLD = """select conv_id, unnest(s.kept)::bigint as turn from (
 select conv_id, list_reduce(list_prepend({'turn': -1, 'bytes': 0, 'used': 0, 'kept': []::int[]}, xs),
  lambda a, x: case when a.used + x.bytes <= 1600 then {'turn': -1, 'bytes': 0, 'used': (a.used + x.bytes)::int, 'kept': list_append(a.kept, x.turn)} else a end) as s
 from (select conv_id, list({'turn': turn::int, 'bytes': (strlen(text) + 60)::int, 'used': 0, 'kept': []::int[]} order by turn) as xs from conversations group by conv_id))"""


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    items = c.select(F.col("conv_id").alias("handoff_id"), F.col("turn").cast("int").alias("ord"), F.col("turn").alias("pos"), (F.octet_length("text") + 60).cast("long").alias("bytes"))
    start = c.select(F.col("conv_id").alias("handoff_id")).distinct().withColumns({"used": F.lit(0).cast("long"), "max_bytes": F.lit(1600).cast("long")})
    return items, start


@query(_FOLD)
def greedy_preferred_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of each conversation fit a 400-token budget, in order, skipping those that don't fit?"""
    return fit(*_turns(spark, sf_dir)).where("kept").select(F.col("handoff_id").alias("conv_id"), F.col("pos").alias("turn"))


@query(_FOLD)
def greedy_fit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_stream(*_turns(spark, sf_dir)).where("kept").select(F.col("handoff_id").alias("conv_id"), F.col("pos").alias("turn"))


CONTRACT = compiler.Contract("Continue the work", ("constraints",), ("decisions", "evidence"), 400)


def _sectioned(spark: SparkSession, sf_dir: str):
    """System turns are constraints, the assistant's are decisions, the user's are evidence."""
    f = conversation_frames(spark, sf_dir)
    kind = F.when(F.col("role") == "system", "constraints").when(F.col("role") == "assistant", "decisions").otherwise("evidence")
    return f.with_(messages=f.messages.withColumn("kind", kind))


def _fit_sql(source: str, n: str = "") -> str:
    """The greedy fit of a table shaped as conversations, with names of its own."""
    out = _ITEMS.replace("from conversations)", f"from {source})")
    for name in ("items", "req", "opt", "fitted", "kept"):
        out = re.sub(rf"\b{name}\b(?!\'|\()", name + n, out) if n else out
    return out.replace(f"'kept{n}'", "'kept'").replace(f".kept{n}", ".kept")


_ITEMS = """items as (select conv_id, turn, case role when 'system' then 'constraints' when 'assistant' then 'decisions' else 'evidence' end as section,
 case role when 'system' then 0 when 'assistant' then 1 else 2 end as ord, role,
 12 + strlen(to_json(text)::varchar) + case role when 'system' then 13 + 8 when 'assistant' then 11 + 8 else 10 + 8 end + case when role <> 'user' then strlen(to_json(role)::varchar) + 8 else 0 end as bytes from conversations),
req as (select conv_id, 169 + 19 + 10 + 8 + sum(bytes) + count(*) - 1 as used from items where ord = 0 group by conv_id having sum(bytes) + count(*) - 1 + 206 <= 1600),
opt as (select conv_id, list({'ord': ord, 'turn': turn::int, 'bytes': bytes::bigint, 'used': 0::bigint, 'sec': -1, 'kept': []::int[]} order by ord, turn) as xs from items where ord > 0 group by conv_id),
fitted as (select conv_id, list_reduce(list_prepend({'ord': -1, 'turn': -1, 'bytes': 0::bigint, 'used': used::bigint, 'sec': -1, 'kept': []::int[]}, coalesce(xs, [])),
 lambda a, x: case when a.used + x.bytes + (a.sec = x.ord)::int <= 1600 then {'ord': -1, 'turn': -1, 'bytes': 0::bigint, 'used': (a.used + x.bytes + (a.sec = x.ord)::int)::bigint, 'sec': x.ord, 'kept': list_append(a.kept, x.turn)} else a end) as s
 from req left join opt using (conv_id)),
kept as (select conv_id, turn from items join req using (conv_id) where ord = 0 union all select conv_id, unnest(s.kept) from fitted)"""


@query(f"with {_ITEMS} select i.conv_id, i.turn, i.section from kept join items i using (conv_id, turn)")
def required_then_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiler.compile_handoff(_sectioned(spark, sf_dir), CONTRACT)
    return out.items.select(F.col("handoff_id").alias("conv_id"), F.col("idx").cast("long").alias("turn"), "section")


@query(f"""with {_ITEMS}, o as (select i.conv_id, i.section, count(*) filter (k.turn is null) as n from items i join req using (conv_id) left join kept k on k.conv_id = i.conv_id and k.turn = i.turn where i.ord > 0 group by 1, 2)
select conv_id, section, n::bigint as omitted from o""")
def omission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _sectioned(spark, sf_dir)
    f = f.with_(messages=compiler.classify(f.messages))
    v = compiler.verdict(f, CONTRACT)[0].where("code is null")
    return v.select(F.col("handoff_id").alias("conv_id"), F.explode("omitted").alias("section", "omitted"))


@query(f"""with {_ITEMS} select conv_id, ((206 + b + c) / 4.0).ceil()::bigint as packet_tokens, n_items, (used / 4.0).ceil()::bigint as required_tokens from (
 select i.conv_id, sum(bytes) as b, count(*) - count(distinct section) as c, count(*)::bigint as n_items, any_value(used) as used from kept join items i using (conv_id, turn) join req on req.conv_id = i.conv_id group by i.conv_id)""")
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiler.compile_handoff(_sectioned(spark, sf_dir), CONTRACT)
    return out.budget.join(out.packets.select("handoff_id", "n_items"), "handoff_id").select(F.col("handoff_id").alias("conv_id"), "packet_tokens", "n_items", "required_tokens")


@query("select conv_id, 'constraints' as missing from conversations group by conv_id having count(*) filter (role = 'system') = 0")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _sectioned(spark, sf_dir)
    gone = compiler.missing_required(f.with_(messages=compiler.classify(f.messages)), CONTRACT)
    return gone.select(F.col("handoff_id").alias("conv_id"), F.array_join("missing", ",").alias("missing"))


@query("select conv_id, case role when 'system' then 'constraints' when 'assistant' then 'decisions' else 'evidence' end as section, count(*)::bigint as n from conversations group by 1, 2")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _sectioned(spark, sf_dir)
    return compiler.section_counts(f.with_(messages=compiler.classify(f.messages))).withColumnRenamed("handoff_id", "conv_id")


_CLEAN = r"regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED:email]', 'g'), '(?:\+|\b)\d[\d ()-]{7,}\d\b', '[REDACTED:phone]', 'g')"
_ITEM_TEXT = "'{\"content\":' || to_json(c.text)::varchar || ',\"kind\":\"' || section || '\"' || case when c.role <> 'user' then ',\"role\":\"' || c.role || '\"' else '' end || '}'"


@query(f"""with {_fit_sql('conversations')}, clean as (select conv_id, turn, role, {_CLEAN} as text from conversations join kept using (conv_id, turn)), {_fit_sql('clean', '2')},
p as (select conv_id, section, string_agg({_ITEM_TEXT}, ',' order by turn) as xs from kept2 join items2 i using (conv_id, turn) join clean c using (conv_id, turn) group by 1, 2),
t as (select conv_id, '{{"artifacts":[],"completed_work":[],"constraints":[' || coalesce(max(xs) filter (section = 'constraints'), '') || '],"decisions":[' || coalesce(max(xs) filter (section = 'decisions'), '') || '],"evidence":[' || coalesce(max(xs) filter (section = 'evidence'), '')
 || '],"failed_attempts":[],"goal":"Continue the work","pending_work":[],"receiver":"receiver","sender":"sender","tool_results":[]}}' as receiver_text from p group by conv_id)
select conv_id, receiver_text, ceil(strlen(receiver_text) / 4)::bigint as packet_tokens from t""")
def compile_with_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets fitted, redacted and fitted again."""
    out = compiler.compile_handoff(_sectioned(spark, sf_dir), CONTRACT, [redact(["email", "phone"])])
    return out.packets.select(F.col("handoff_id").alias("conv_id"), "receiver_text", "packet_tokens")


_PACKET = """select conv_id, section, (row_number() over (partition by conv_id, section order by turn) - 1)::int as pos,
 '{"content":' || to_json(text)::varchar || ',"kind":"' || section || '"' || case when role <> 'user' then ',"role":"' || role || '"' else '' end || '}' as item from kept join items i using (conv_id, turn) join conversations c using (conv_id, turn)"""


@query("with " + _ITEMS + " " + _PACKET.replace("role ", "c.role ").replace("|| role", "|| c.role"))
def packet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets rendered, then read back item by item."""
    out = compiler.compile_handoff(_sectioned(spark, sf_dir), CONTRACT)
    return packets.decode(out.packets).select(F.col("handoff_id").alias("conv_id"), "section", "pos", "item")


# ---- routes

_RULES = [("r0", "en*", "src1*"), ("r1", "*", "src1"), ("r2", "f?", "*"), ("r3", "[!e]?", "src[2-4]")]


def _routed(spark: SparkSession, sf_dir: str, on_multiple: str, on_unmatched: str = "error") -> DataFrame:
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("handoff_id"), F.col("lang").alias("sender"), F.col("source").alias("receiver"))
    rules = rules_table(spark, [Rule(s, r, rule_id=i) for i, s, r in _RULES])
    return resolve(heads, rules, on_multiple=on_multiple, on_unmatched=on_unmatched)


_MATCH = "m as (select doc_id, id, n from documents, (values " + ", ".join(f"({n}, '{i}', '{s}', '{r}')" for n, (i, s, r) in enumerate(_RULES)) + ") v(n, id, s, r) where lang glob s and source glob r)"


@query(f"with {_MATCH} select doc_id, arg_min(id, n) as rule_id from m group by doc_id")
def route_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, "first").where("size(rule_ids) = 1").select(F.col("handoff_id").alias("doc_id"), F.col("rule_ids")[0].alias("rule_id"))


@query(f"with {_MATCH} select doc_id, string_agg(id, ',' order by n) as rule_ids from m group by doc_id")
def route_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, "all").where("size(rule_ids) > 0").select(F.col("handoff_id").alias("doc_id"), F.array_join("rule_ids", ",").alias("rule_ids"))


@query(f"with {_MATCH} select doc_id, 'ambiguous_route' as code from m group by doc_id having count(*) > 1")
def route_match_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, "error").where("code = 'ambiguous_route'").select(F.col("handoff_id").alias("doc_id"), "code")


@query(f"with {_MATCH} select doc_id, true as warned from documents where doc_id not in (select doc_id from m)")
def route_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, "all", "warn").where("warned").select(F.col("handoff_id").alias("doc_id"), "warned")


# ---- state

_STATE = """e as (select event_id, user_id, case event_type when 'click' then 'pending_work' when 'purchase' then 'completed_work' when 'view' then 'decisions' when 'error' then 'evidence' end as section,
 row_number() over (order by ts, event_id) as i from events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("event_type") == "click", "pending_work").when(F.col("event_type") == "purchase", "completed_work").when(F.col("event_type") == "view", "decisions").when(F.col("event_type") == "error", "evidence")
    return table(spark, sf_dir, "events").select("event_id", "user_id", section.alias("section"), F.struct("ts", "event_id").alias("i"))


@query(f"with {_STATE}, l as (select *, max(i) over (partition by user_id, section) as last from e) select user_id, section, event_id from l where section is not null and i = last")
def state_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("section is not null and section not in ('pending_work', 'completed_work')")
    p = _events(spark, sf_dir).where("section in ('pending_work', 'completed_work')").withColumn("user_id", F.col("user_id"))
    w = state.last_writer(e, [], "section", "user_id", "i").where("alive")
    # each of the two closing sections on its own, so that nothing closes
    both = [state.last_writer(p.where(F.col("section") == s), [], "section", "user_id", "i").where("alive") for s in ("pending_work", "completed_work")]
    return w.unionByName(both[0]).unionByName(both[1]).select("user_id", "section", "event_id")


@query(f"""with {_STATE}, l as (select *, max(i) over (partition by user_id, section) as last, max(case when section = 'completed_work' then i end) over (partition by user_id) as done from e)
select event_id from l where section is null or (i = last and not (section = 'pending_work' and coalesce(done > i, false)))""")
def state_closed_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_writer(_events(spark, sf_dir), [], "section", "user_id", "i").where("alive").select("event_id")


_SCOPED = """(1, 0, 'a', 'decisions', 'k', 't1'), (1, 1, 'b', 'decisions', 'k', 't2'), (1, 2, 'c', 'decisions', 'k', null), (1, 3, 'd', 'decisions', 'k', 't1'), (1, 4, 'e', 'message', null, null),
 (2, 0, 'a', 'pending_work', 'k', null), (2, 1, 'b', 'completed_work', 'k', null), (2, 2, 'c', 'pending_work', 'k', null), (3, 0, 'x', 'message', null, null), (3, 1, 'x', 'message', null, null)"""


@case(f"""with v as (select * from (values {_SCOPED}) v(h, i, t, s, k, task) where task is null or task = 't1'),
l as (select *, max(i) over (partition by h, task, s, k) as last, max(case when s = 'completed_work' then i end) over (partition by h, task, k) as done from v),
a as (select * from l where k is null or (i = last and not (s = 'pending_work' and coalesce(done > i, false))))
select h, i from (select h, i, row_number() over (partition by h, t, s, k, task order by i) as n from a) where n = 1""")
def task_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, _SCOPED, "h, i, t, s, k, task")
    meta = F.to_json(F.struct(F.col("k").alias("state_key"), F.col("task").alias("task_id")))
    m = text_messages(v, F.col("h"), F.col("i"), F.lit("user"), F.col("t"), kind=F.col("s"), metadata_json=meta)
    heads = v.select(F.col("h").cast("long").alias("handoff_id"), F.lit("s").alias("sender"), F.lit("r").alias("receiver"), F.lit("{}").alias("metadata_json")).distinct()
    return state.prepare(frames(spark, heads, m, nested=True), "t1").messages.select(F.col("handoff_id").cast("int").alias("h"), F.col("msg_idx").alias("i"))


# ---- classification

_HEADS = """('a', 'Decision: keep it'), ('b', '**TODO:** write tests'), ('c', '## Constraint: no network'), ('d', '待办： 测试'), ('e', 'we said Decision: no'), ('f', 'Decision:'), ('g', '- Must : hold'), ('h', '**Evidence** : seen'), ('i', 'completed work: all'), ('j', 'Nothing here')"""
_LABEL_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in TEXT_LABELS.items())


@case(rf"""with t as (select id, regexp_replace(regexp_replace(trim(t), '^(?:[-*][ \t]+)?(?:#{{1,6}}[ \t]+)?', ''), '^\*\*\s*([^*:：]*?)\s*([:：]?)\s*\*\*', '\1\2') as t from (values {_HEADS}) v(id, t)),
p as (select id, lower(trim(regexp_extract(t, '^([^:：]*)[:：]', 1))) as label, trim(regexp_extract(t, '^[^:：]*[:：](.*)$', 1)) as body from t)
select id, section, body from p join (values {_LABEL_ROWS}) l(label, section) using (label) where body <> ''""")
def classify_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    section, body = cl.text_section(F.col("t"))
    return values(spark, _HEADS, "id, t").select("id", section.alias("section"), body.alias("body")).where("section is not null")


_DICTS = """('a', '{"Decision":"x","note":1}'), ('b', '{"to-do":"x","TODO":"y"}'), ('c', '{"decision":1,"evidence":2}'), ('d', '{"other":1}'), ('e', '{"done":true,"completed_work":[1]}')"""
_KEY_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in KEY_SECTIONS.items())


@case(rf"""with k as (select id, unnest(json_keys(j)) as k from (select id, t::json as j from (values {_DICTS}) v(id, t)))
select id, min(section) as section from (select id, trim(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '_') as label from k) join (values {_KEY_ROWS}) l(label, section) using (label) group by id having count(distinct section) = 1""")
def classify_dict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cl.structured_sections(F.col("t"))
    return values(spark, _DICTS, "id, t").select("id", F.when(F.size(s) == 1, F.get(s, 0)).alias("section")).where("section is not null")


_NOTES = [
    "intro line\nDecision: use parquet\nmore on it\nTODO: test",
    "Constraint: none\n```\nDecision: in a fence\n```\nEvidence: log",
    "Decision: only one",
    "待办： 写测试\n**Done:** all\n",
    "TODO:\nDecision: x",
]
_PARTS = """(0, 0, null, 'intro line'), (0, 1, 'decisions', E'use parquet\\nmore on it'), (0, 2, 'pending_work', 'test'), (1, 0, 'constraints', E'none\\n```\\nDecision: in a fence\\n```'), (1, 1, 'evidence', 'log'),
 (2, 0, 'decisions', 'only one'), (3, 0, 'pending_work', '写测试'), (3, 1, 'completed_work', 'all'), (4, 0, null, 'TODO:'), (4, 1, 'decisions', 'x')"""


@case(f"select * from (values {_PARTS}) v(h, part, section, content)")
def split_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(list(enumerate(_NOTES)), "h bigint, t string")
    m = text_messages(v, F.col("h"), F.lit(0), F.lit("user"), F.col("t"))
    return normalize.normalize(m).select(F.col("handoff_id").cast("int").alias("h"), F.col("part").cast("int").alias("part"), "section", "content")


_OBJECTS = """(0, '{"evidence":"seen","note":"n","decision":{"b":1,"a":2},"more":[1]}'), (1, '{"decision":"x","note":1}')"""


@case("""select * from (values (0, 0, 'evidence', 'text', 'seen'), (0, 1, 'decisions', 'object', '{"b":1,"a":2}'), (0, 2, null, 'object', '{"note":"n","more":[1]}'), (1, 0, 'decisions', 'object', '{"decision":"x","note":1}')) v(h, part, section, content_type, content)""")
def split_dict_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, _OBJECTS, "h, t")
    m = text_messages(v, F.col("h"), F.lit(0), F.lit("user"), F.col("t")).withColumn("content_type", F.lit("object"))
    return normalize.normalize(m, nested=True).select(F.col("handoff_id").cast("int").alias("h"), F.col("part").cast("int").alias("part"), "section", "content_type", "content")


@query("select conv_id, count(*) filter (role = 'tool')::bigint as classified, list(turn::int order by turn) filter (role <> 'tool') as unclassified from conversations group by conv_id")
def unclassified_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = normalize.report(normalize.normalize(conversation_messages(spark, sf_dir)))
    return told.select(F.col("handoff_id").alias("conv_id"), "classified", F.col("unclassified_indices").alias("unclassified"))


@query("""with m as (select conv_id, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as body, case when role = 'assistant' then 'Decision: ' || text else text end as t from conversations)
select conv_id, (ceil((93 + sum(57 + strlen(to_json(t)::varchar) + 9 + 2 + strlen(to_json(role)::varchar) + 2) + 2 * (count(*) - 1)) / 4) + 4)::bigint as source_tokens,
 ceil((169 + 7 + 10 + 8 + sum(12 + strlen(to_json(body)::varchar) + 19 + 19) filter (role = 'assistant') + count(*) filter (role = 'assistant') - 1) / 4)::bigint as packet_tokens, 0::bigint as omitted_count
from m group by conv_id having count(*) filter (role = 'assistant') > 0""")
def compile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories normalized and compiled for a receiver that prefers decisions and open work."""
    f = conversation_frames(spark, sf_dir)
    labelled = F.when(F.col("role") == "assistant", F.concat(F.lit("Decision: "), F.col("content"))).otherwise(F.col("content"))
    out, _ = compiler.compile_history(f.with_(messages=f.messages.withColumn("content", labelled)), compiler.Contract("Go on", ("decisions",), ("pending_work",), 4000))
    return out.budget.select(F.col("handoff_id").alias("conv_id"), "source_tokens", "packet_tokens", "omitted_count")


# ---- tools, artifacts

_TOOLS = """(1, 0, 'a', true), (1, 1, 'a', false), (2, 0, 'a', false), (3, 0, 'a', true), (3, 1, 'a', true), (4, 0, 'a', true), (4, 1, 'a', false), (4, 2, 'a', false), (5, 0, 'a', true), (6, 0, null, true), (7, 0, 'a', true), (7, 1, 'b', true), (7, 2, 'b', false), (7, 3, 'a', false)"""


@case(f"""with v as (select *, count(*) filter (c) over w as calls, count(*) filter (not c) over w as outs from (values {_TOOLS}) v(h, i, id, c) window w as (partition by h, id order by i rows between unbounded preceding and 1 preceding)),
e as (select h, i, case when id is null then 'missing_call_id' when c and calls > 0 then 'reused_call_id' when not c and calls = 0 then 'orphan_output' when not c and outs > 0 then 'duplicate_output' end as code from v),
f as (select h, arg_min(code, i) as code from e where code is not null group by h),
u as (select distinct h, 'unfinished_call' as code from (select h, id from (values {_TOOLS}) v(h, i, id, c) group by h, id having count(*) filter (not c) = 0) where h not in (select h from f))
select h, code from f union select h, code from u""")
def tool_pair_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, _TOOLS, "h, i, id, c").select(F.col("h").alias("handoff_id"), F.col("i").alias("pos"), F.col("id").alias("call_id"), F.col("c").alias("is_call"))
    return tools.validate(v).select(F.col("handoff_id").alias("h"), "code")


@query("""with d as (select source as h, lang || length(text) % 7 as name, n_chars, doc_id, length(text) % 2 = 1 as fresh from documents), old as (select * from d where not fresh), new as (select * from d where fresh),
u as (select h, name, n_chars, 0 as side, doc_id from old where (h, name) not in (select (h, name) from new) union all select h, name, n_chars, 1, doc_id from new)
select h, name, n_chars, (row_number() over (partition by h order by side, doc_id) - 1)::int as art_idx from (select *, row_number() over (partition by h, name, n_chars order by side, doc_id) as n from u) where n = 1""")
def artifact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts of their source, those of even length inherited, the others current."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("handoff_id"), F.col("doc_id").alias("art_idx"), F.concat("lang", (F.length("text") % 7).cast("string")).alias("name"), "n_chars", (F.length("text") % 2 == 1).alias("fresh"))
    out = packets.merge_artifacts(d.where("not fresh").drop("fresh"), d.where("fresh").drop("fresh"))
    return out.select(F.col("handoff_id").alias("h"), "name", "n_chars", "art_idx")


@query("select conv_id, turn, strlen(to_json(text)::varchar)::bigint as n from conversations")
def json_literal_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tk.literal_bytes(F.col("text")).alias("n"))
