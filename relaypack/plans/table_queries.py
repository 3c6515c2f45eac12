"""Queries over whole tables whose rows are made into headings, objects, tool calls, listings and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.functions import classify as cl
from relaypack.functions.patterns import KEY_SECTIONS, TEXT_LABELS
from relaypack.operators import evaluation as ev
from relaypack.operators import normalize, state, tools
from relaypack.operators import policies as po
from relaypack.operators import selection as se
from relaypack.operators import spans as sp
from relaypack.operators.compiler import Contract
from relaypack.operators.frames import Frames, frames, text_messages
from relaypack.operators.redact import pattern_chain, redact, redact_text
from relaypack.operators.shared import cut
from relaypack.plans.common import conversation_frames, table
from relaypack.plans.text_queries import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _heads(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json").distinct()


# ---- state


_STATE = {"s": "case role when 'system' then 'decisions' when 'assistant' then 'completed_work' else 'pending_work' end", "k": "case when length(text) % 5 > 0 then concat('k', length(text) % 2) end", "task": "case turn % 3 when 0 then 't1' when 1 then null else 't2' end"}


@query(f"""with v as (select conv_id, turn, text, {', '.join(f'{x} as {n}' for n, x in _STATE.items())} from conversations), w as (select * from v where task is null or task = 't1'),
l as (select *, max(turn) over (partition by conv_id, task, s, k) as last, max(case when s = 'completed_work' then turn end) over (partition by conv_id, task, k) as done from w),
a as (select * from l where k is null or (turn = last and not (s = 'pending_work' and coalesce(done > turn, false))))
select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id, text, s, k, task order by turn) as n from a) where n = 1""")
def task_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for one task: its own rows and those of no task, the last of each key, nothing pending that was completed since."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id as handoff_id", "turn", "text", *(f"{x} as {n}" for n, x in _STATE.items()))
    meta = F.to_json(F.struct(F.col("k").alias("state_key"), F.col("task").alias("task_id")))
    m = text_messages(c, F.col("handoff_id"), F.col("turn"), F.lit("user"), F.col("text"), kind=F.col("s"), metadata_json=meta)
    return state.prepare(frames(spark, _heads(c), m, nested=True), "t1").messages.select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"))


# ---- classification

_MARKS = ("Decision: ", "**TODO:** ", "## Constraint: ", "待办： ", "we said Decision: ", "Decision:\n", "- Must : ", "**Evidence** : ", "completed work: ", "")
_LABELLED = "case doc_id % 10 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(_MARKS[:5])) + " when 5 then concat('Decision:', chr(10)) " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(_MARKS) if i > 5) + " end"
_LABEL_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in TEXT_LABELS.items())


@query(rf"""with t as (select doc_id, regexp_replace(regexp_replace({_LABELLED} || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '^(?:[-*][ \t]+)?(?:#{{1,6}}[ \t]+)?', ''), '^\*\*\s*([^*:：]*?)\s*([:：]?)\s*\*\*', '\1\2') as t from documents),
p as (select doc_id, lower(trim(regexp_extract(t, '^([^:：]*)[:：]', 1))) as label, regexp_replace(regexp_extract(t, '(?s)^[^:：]*[:：](.*)$', 1), '^\s+|\s+$', '', 'g') as body from t)
select doc_id, section, md5(body) as body from p join (values {_LABEL_ROWS}) l(label, section) using (label) where body <> ''""")
def classify_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under one of ten openings."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat({_LABELLED}, trim(both ' \n\t\r\f' from coalesce(text, ''))) as t")
    # exploded, so that a filter doesn't compute the section once more
    found = F.explode(F.filter(F.array(cl.text_label(F.col("t"))), lambda h: h["section"].isNotNull())).alias("h")
    return d.select("doc_id", found).select("doc_id", "h.section", F.md5("h.body").alias("body"))


_OBJECT = """case n_chars % 5 when 0 then concat('{"Decision":"x","note":', doc_id, '}') when 1 then concat('{"to-do":"x","TODO":', doc_id, '}') when 2 then '{"decision":1,"evidence":2}' when 3 then '{"other":1}' else '{"done":true,"completed_work":[1]}' end"""
_KEY_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in KEY_SECTIONS.items())


@query(rf"""with k as (select doc_id, unnest(json_keys(j)) as k from (select doc_id, ({_OBJECT})::json as j from documents))
select doc_id, min(section) as section from (select doc_id, trim(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '_') as label from k) join (values {_KEY_ROWS}) l(label, section) using (label) group by doc_id having count(distinct section) = 1""")
def classify_dict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cl.structured_sections(F.col("t"))
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_OBJECT} as t")
    return d.select("doc_id", F.when(F.size(s) == 1, F.get(s, 0)).alias("section")).where("section is not null")


_BODY = "trim(regexp_replace(text, '[\\s:]+', ' ', 'g'))"


@query(f"""with c as (select conv_id, turn, {_BODY} as b from conversations)
select conv_id, turn, (turn % 3 = 1)::int as part, 'decisions' as section, md5(b || case when turn % 3 = 2 then chr(10) || '```' || chr(10) || 'TODO: in a fence' || chr(10) || '```' else '' end) as content from c
union all select conv_id, turn, 0, null, md5('intro line') from c where turn % 3 = 1 union all select conv_id, turn, 1 + (turn % 3 = 1)::int, 'pending_work', md5('t' || turn) from c""")
def split_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a text of two sections or three, some with a heading in a fence."""
    body = F.trim(F.regexp_replace("text", r"[\s:]+", " "))
    t = F.concat(F.when(F.col("turn") % 3 == 1, "intro line\n").otherwise(""), F.lit("Decision: "), body, F.when(F.col("turn") % 3 == 2, "\n```\nTODO: in a fence\n```").otherwise(""), F.lit("\nTODO: t"), F.col("turn").cast("string"))
    m = text_messages(table(spark, sf_dir, "conversations").withColumn("t", t), F.col("conv_id"), F.col("turn"), F.lit("user"), F.col("t"))
    return normalize.normalize(m).select(F.col("handoff_id").alias("conv_id"), F.col("source_idx").cast("long").alias("turn"), F.col("part").cast("int").alias("part"), "section", F.md5("content").alias("content"))


@query("""select conv_id, turn, 0 as part, 'evidence' as section, 'text' as content_type, role as content from conversations union all select conv_id, turn, 1, 'decisions', 'object', '{"b":' || turn || ',"a":2}' from conversations
union all select conv_id, turn, 2, null, 'object', '{"note":' || turn || ',"more":[1]}' from conversations""")
def split_dict_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = """concat('{"evidence":"', role, '","note":', turn, ',"decision":{"b":', turn, ',"a":2},"more":[1]}') as t"""
    m = text_messages(table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", t), F.col("conv_id"), F.col("turn"), F.lit("user"), F.col("t")).withColumn("content_type", F.lit("object"))
    return normalize.normalize(m, nested=True).select(F.col("handoff_id").alias("conv_id"), F.col("source_idx").cast("long").alias("turn"), F.col("part").cast("int").alias("part"), "section", "content_type", "content")


# ---- tools

_CALLS = {"conv_id": "conv_id", "turn": "turn", "id": "case when length(text) % 9 = 0 then null else concat('c', case when conv_id % 2 = 0 then cast(floor(turn / 2) as int) else length(text) % 3 end) end", "c": "turn % 2 = 0"}


@query(f"""with r as (select {', '.join(f'{x} as {n}' for n, x in _CALLS.items())} from conversations), v as (select *, count(*) filter (c) over w as calls, count(*) filter (not c) over w as outs from r window w as (partition by conv_id, id order by turn rows between unbounded preceding and 1 preceding)),
e as (select conv_id, turn, case when id is null then 'missing_call_id' when c and calls > 0 then 'reused_call_id' when not c and calls = 0 then 'orphan_output' when not c and outs > 0 then 'duplicate_output' end as code from v),
f as (select conv_id, arg_min(code, turn) as code from e where code is not null group by conv_id),
u as (select distinct conv_id, 'unfinished_call' as code from (select conv_id, id from r group by conv_id, id having count(*) filter (not c) = 0) where conv_id not in (select conv_id from f))
select conv_id, code from f union select conv_id, code from u""")
def tool_pair_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as calls and outputs, with ids that are missing, reused or left open."""
    r = table(spark, sf_dir, "conversations").selectExpr(*(f"{x} as {n}" for n, x in _CALLS.items()))
    out = tools.validate(r.select(F.col("conv_id").alias("handoff_id"), F.col("turn").alias("pos"), F.col("id").alias("call_id"), F.col("c").alias("is_call")))
    return out.select(F.col("handoff_id").alias("conv_id"), "code")


# ---- policies

_KEY = r"\b(?:sk-[A-Za-z0-9_-]{8,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,})\b"


@query(f"select doc_id, len(regexp_extract_all(text, '{_KEY}'))::bigint as n, md5(regexp_replace(text, '{_KEY}', '[REDACTED:api_key]', 'g')) as digest from documents")
def redact_api_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = redact_text(F.col("text"), pattern_chain(["api_key"]))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), F.md5(text).alias("digest"))


@query("select conv_id, turn from (select conv_id, turn, role = 'system' or length(text) % 4 = 0 as p, row_number() over (partition by conv_id, role = 'system' or length(text) % 4 = 0, role order by turn) as n from conversations) where p or n = 1")
def dedup_protected_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that say no more than their role; protected ones are no repeats and make none."""
    c = table(spark, sf_dir, "conversations").withColumn("p", (F.col("role") == "system") | (F.length("text") % 4 == 0))
    m = text_messages(c, F.col("conv_id"), F.col("turn"), F.lit("user"), F.col("role"))
    m = m.join(c.select(F.col("conv_id").alias("handoff_id"), F.col("turn").cast("int").alias("msg_idx"), F.col("p").alias("protected")), ["handoff_id", "msg_idx"]).withColumn("src_key", F.lit(None).cast("string"))
    return po.dedup_marks(m).where("not dup").select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"))


@query("select conv_id, turn, 'write [REDACTED:email]' as content from (select conv_id, turn, row_number() over (partition by conv_id, length(text) % 3 order by turn) as n from conversations) where n = 1")
def dedup_after_redaction_keeps_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that differ stay apart though they read alike afterwards."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.concat(F.lit("write a"), (F.length("text") % 3).cast("string"), F.lit("@b.org")))
    f = frames(spark, _heads(c.withColumnRenamed("conv_id", "handoff_id")), text_messages(c, F.col("conv_id"), F.col("turn"), F.lit("user"), F.col("t")))
    out = po.deduplicate()(redact(["email"], keep_source=True)(f)).messages
    return out.select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"), "content")


@query("""select conv_id, turn, '{"owner":"' || role || '","due":{"b":' || turn || ',"a":[1,2]}}' as content from conversations c where not exists (select 1 from conversations d where d.conv_id = c.conv_id and length(d.text) % 12 = 0)""")
def schema_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a key too many; one without a required key denies its conversation."""
    t = """case when length(text) % 12 = 0 then concat('{"owner":"', role, '"}') else concat('{"extra":1,"owner":"', role, '","due":{"b":', turn, ',"a":[1,2]}}') end as t"""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id as handoff_id", "turn", t)
    m = text_messages(c, F.col("handoff_id"), F.col("turn"), F.lit("user"), F.col("t"), kind=F.lit("structured")).withColumn("content_type", F.lit("object"))
    f = po.required_fields(["owner", "due"])(frames(spark, _heads(c), m, nested=True))
    return f.messages.select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"), "content")


# ---- listings: a document's words as lines of code, by their length blank, indented, or opening a block


def _listings(spark: SparkSession, sf_dir: str) -> Frames:
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    n = lambda w: F.length(w)
    line = lambda w: F.when(n(w) % 7 == 0, "").otherwise(F.concat(F.repeat(F.lit(" "), (n(w) % 3 * 2).cast("int")), F.when(n(w) % 5 == 0, "if x:").otherwise("y")))
    rows = d.select("doc_id", words.alias("ws")).where("size(ws) > 0")
    text = F.concat(F.format_string("File: a.py (%d lines)\n", F.size("ws")), F.array_join(F.transform("ws", lambda w, i: F.concat((i + 1).cast("string"), F.lit(": "), line(w))), "\n"))
    made = cut(rows.select("doc_id", text.alias("t")), "listings")  # every reader would make the texts anew
    return frames(spark, _heads(made.select(F.col("doc_id").alias("handoff_id"))), text_messages(made, F.col("doc_id"), F.lit(0), F.lit("tool"), F.col("t")))


_WINDOWS = r"""w0 as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as k, len(ws) as n from (select doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') as ws from documents where doc_id is not null)),
l as (select doc_id, k, n, length(w) % 7 = 0 as blank, case when length(w) % 7 <> 0 then length(w) % 3 end as depth, length(w) % 7 <> 0 and length(w) % 5 = 0 as opens, max(case when length(w) % 7 = 0 then k end) over (partition by doc_id order by k) as b from w0),
cut as (select doc_id, 0 as e, 0 as part, n from l where k = 1 union all select c.doc_id, case when c.e + 40 < c.n then case when coalesce(x.b, 0) > c.e + 30 then x.b else c.e + 40 end else c.n end, c.part + 1, c.n from cut c left join l x on x.doc_id = c.doc_id and x.k = c.e + 40 where c.e < c.n),
win as (select doc_id, part, lag(e) over (partition by doc_id order by part) as s, e from cut qualify part > 0),
pos as (select l.*, (select count(*) from range(0)) as z, min(case when depth = 0 then k end) over f as n0, min(case when depth <= 1 then k end) over f as n1, min(case when depth <= 2 then k end) over f as n2 from l window f as (partition by doc_id order by k rows between 1 following and unbounded following)),
op as (select p.doc_id, w.part, p.k, coalesce(case depth when 0 then n0 when 1 then n1 else n2 end, 1000000000) as stop from pos p join win w on w.doc_id = p.doc_id and p.k > w.s and p.k <= w.e where opens),
sig as (select w.doc_id, w.part, min(l.k) as k from win w join l on l.doc_id = w.doc_id and l.k > w.s and l.k <= w.e and not blank group by 1, 2),
ctx as (select distinct s.doc_id, s.part, o.part as needs from sig s join op o on o.doc_id = s.doc_id and o.part < s.part and s.k < o.stop union select doc_id, part, 0 from win)"""


@query(f"with recursive {_WINDOWS} select w.doc_id, w.part, (e - s)::int as n_lines, string_agg(c.needs::varchar, ',' order by c.needs) as context from win w join ctx c using (doc_id, part) group by 1, 2, 3")
def code_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every listing: where they end, and the header and open blocks that they depend on."""
    u = sp.source_units(_listings(spark, sf_dir)).where("part > 0")
    n = F.size(F.filter(F.split("content", "\n"), lambda x: x != ""))
    return u.select(F.col("handoff_id").alias("doc_id"), "part", n.cast("int").alias("n_lines"), F.array_join(F.transform("context", lambda c: F.substring_index(c, ".", -1)), ",").alias("context"))


@query(f"with recursive {_WINDOWS}, r(doc_id, part, needs) as (select doc_id, part, part from win union select r.doc_id, r.part, c.needs from r join ctx c on c.doc_id = r.doc_id and c.part = r.needs) select doc_id, part, count(*)::bigint as n_needs, sum(needs)::bigint as needs from r group by 1, 2 union all select distinct doc_id, 0, 1, 0 from win")
def context_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each window needs, directly or not."""
    c = sp.closure(sp.source_units(_listings(spark, sf_dir)))
    part = lambda n: F.substring_index(n, ".", -1).cast("int")
    return c.groupBy(F.col("handoff_id").alias("doc_id"), part("unit_id").alias("part")).agg(F.count(F.lit(1)).alias("n_needs"), F.sum(part("needs")).alias("needs"))


# ---- plans and answers

_RULES = ("unknown_unit", "repeated_unit", "unrequested_section", "wrong_origin", "empty_plan", "required_missing", "bad_need", "source_not_selected", "need_uncovered")


@query("select conv_id, case conv_id % 10 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_RULES, 1)) + " end as code from (select distinct conv_id from conversations) where conv_id % 10 > 0")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each conversation; of ten, nine break a rule each."""
    f = conversation_frames(spark, sf_dir)
    units = sp.source_units(f).select("handoff_id", "unit_id", "origin", "idx", "part")
    first = units.groupBy("handoff_id").agg(F.min_by("unit_id", F.struct("idx", "part")).alias("u"))
    case = F.col("handoff_id") % 10
    row = lambda rank, unit, section: F.struct(F.lit(rank).alias("rank"), unit.alias("unit_id"), F.lit(section).alias("section"), F.lit(True).alias("essential"))
    u, gone = F.col("u"), F.lit("m99.99")
    plans = F.when(case == 1, F.array(row(1, gone, "decisions"))).when(case == 2, F.array(row(1, u, "decisions"), row(2, u, "evidence"))).when(case == 3, F.array(row(1, u, "tool_results"))).when(case == 4, F.array(row(1, u, "artifacts"))).when(case == 6, F.array(row(1, u, "evidence"))).when(case == 5, F.array().cast("array<struct<rank:int,unit_id:string,section:string,essential:boolean>>")).otherwise(F.array(row(1, u, "decisions")))
    plan = first.select("handoff_id", F.explode(plans).alias("p")).select("handoff_id", "p.*")
    need = lambda k, ids: F.struct(F.lit(k).alias("need"), ids.alias("unit_ids"))
    mine = F.array(u)
    covers = F.when(case.isin(3, 4, 5), F.array().cast("array<struct<need:int,unit_ids:array<string>>>")).when(case == 7, F.array(need(5, mine))).when(case == 8, F.array(need(0, F.array(gone)), need(1, mine))).when(case == 9, F.array(need(0, mine))).when(case == 1, F.array(need(0, F.array(gone)), need(1, F.array(gone)))).otherwise(F.array(need(0, mine), need(1, mine)))
    cover = first.select("handoff_id", F.explode(covers).alias("c")).select("handoff_id", "c.*")
    contract = Contract("g", ("decisions",), ("evidence", "artifacts"), 100, ("n0", "n1"))
    return se.check_plan(units, plan, cover, contract, f.handoffs).select(F.col("handoff_id").alias("conv_id"), "code")


_ANSWER = """case length(text) % 6 when 0 then '{"a":NaN}' when 1 then '{"a":1,"a":1}' when 2 then '{"c":1}' else concat('{"a":', turn, ',"b":["x","', role, '"],"d":{"e":[', turn % 2, ']}}') end"""


@query("""select conv_id, turn, 3::bigint as n_checks, case when length(text) % 6 < 3 then 0 else (turn = 2)::int + (role = 'user')::int + (turn % 2 = 1)::int end::bigint as n_passed, length(text) % 6 >= 3 and turn = 2 and role = 'user' and turn % 2 = 1 as success from conversations""")
def grade_equals_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks of an answer for each turn; answers that are no strict JSON pass none."""
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("answer_id"), F.expr(_ANSWER).alias("answer"))
    check = lambda p, o, e: F.struct(F.lit(p).alias("check_path"), F.lit(o).alias("operator"), F.lit(e).alias("expected"))
    checks = F.explode(F.array(check("a", "equals", "2"), check("b", "contains_all", '["user","x"]'), check("d.e", "equals", "[1]"))).alias("k")
    return ev.grade(c.select("answer_id", "answer", checks).select("answer_id", "answer", "k.*")).select("answer_id.conv_id", "answer_id.turn", "n_checks", "n_passed", "success")
