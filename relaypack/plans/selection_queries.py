"""Queries: source spans, selection plans, excerpts, evaluation, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.functions.text import lines
from relaypack.operators import evaluation as ev
from relaypack.operators import policies as po
from relaypack.operators import selection as se
from relaypack.operators import spans as sp
from relaypack.operators.compiler import Contract
from relaypack.operators.frames import frames, text_messages
from relaypack.operators.redact import redact
from relaypack.plans.common import conversation_frames, table, values
from relaypack.plans.pipeline import reports, run_policies
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


_LINES = "select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from conversations where not regexp_matches(text, '[\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]') and not contains(text, '```') and not contains(text, '~~~')"


@query(f"select conv_id, turn, count(*)::bigint as n_spans, sum(length(line))::bigint as n_chars from ({_LINES}) where trim(line, E' \\t') <> '' group by conv_id, turn")
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonblank lines of each message as addressable spans."""
    u = sp.source_units(conversation_frames(spark, sf_dir))
    line = F.regexp_replace("content", "\n$", "")
    return u.groupBy(F.col("handoff_id").alias("conv_id"), F.col("idx").cast("long").alias("turn")).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.length(line)).alias("n_chars"))


def _listing() -> str:
    rows = ["def f():"] + ["    x = 1"] * 33 + [""] + ["    y = 2"] * 60
    return f"File: a.py ({len(rows)} lines)\n" + "".join(f"{i + 1}: {r}\n" for i, r in enumerate(rows))


def _listing_frames(spark: SparkSession):
    v = spark.createDataFrame([(1, 0, "tool", _listing()), (1, 1, "user", "one\n\ntwo\n")], "h bigint, i int, r string, t string")
    heads = spark.createDataFrame([(1, "s", "r", "{}")], "handoff_id bigint, sender string, receiver string, metadata_json string")
    return frames(spark, heads, text_messages(v, F.col("h"), F.col("i"), F.col("r"), F.col("t")))


@case("select * from (values ('m0.0', 0, ''), ('m0.1', 35, 'm0.0'), ('m0.2', 40, 'm0.0,m0.1'), ('m0.3', 20, 'm0.0,m0.1'), ('m1.0', 1, ''), ('m1.1', 1, '')) v(unit_id, n_lines, context)")
def code_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered listing of 95 lines: windows end at a near blank line and depend on the header and on the open block."""
    u = sp.source_units(_listing_frames(spark))
    n = F.when(F.col("unit_id") == "m0.0", 0).otherwise(F.size(lines(F.col("content"))))
    return u.select("unit_id", n.cast("int").alias("n_lines"), F.array_join("context", ",").alias("context"))


@case("""with recursive e(u, c) as (select * from (values ('m0.1', 'm0.0'), ('m0.2', 'm0.0'), ('m0.2', 'm0.1'), ('m0.3', 'm0.0'), ('m0.3', 'm0.1')) v(u, c)),
n(u) as (select * from (values ('m0.0'), ('m0.1'), ('m0.2'), ('m0.3'), ('m1.0'), ('m1.1')) v(u)),
r(u, c) as (select u, u from n union select r.u, e.c from r join e on e.u = r.c) select u as unit_id, c as needs from r""")
def context_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.closure(sp.source_units(_listing_frames(spark))).select("unit_id", "needs")


@query("""with s as (select conv_id, turn, role, sum(length(text)) over w - length(text) as start, sum(length(text)) over w as stop, text from conversations window w as (partition by conv_id order by turn)),
i as (select *, sum(case when lag is null or lag <> start then 1 else 0 end) over (partition by conv_id, role order by start, turn) as g from (select *, lag(stop) over (partition by conv_id, role order by start, stop, turn) as lag from s))
select conv_id, role, min(start)::bigint as start, max(stop)::bigint as stop, md5(string_agg(text, '' order by start, stop)) as digest, list(turn order by start, stop) as turns from i group by conv_id, role, g""")
def coalesce_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as spans of their conversation; adjacent ones of one role become one."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("end", F.sum(F.length("text")).over(w))
    s = c.withColumns({"start": F.col("end") - F.length("text"), "handoff_id": F.col("conv_id"), "unit_id": F.col("turn"), "content": F.col("text")})
    out = sp.coalesce(s, by=("handoff_id", "role"))
    return out.select(F.col("handoff_id").alias("conv_id"), "role", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), F.md5("content").alias("digest"), F.col("source_ids").alias("turns"))


_CONTRACT = Contract("g", ("decisions",), ("evidence", "artifacts"), 100, ("n0", "n1"))
_PLAN = """(1, 1, 'm1.0', 'decisions', true), (1, 2, 'm1.1', 'evidence', false), (2, 1, 'm9.9', 'decisions', false), (3, 1, 'm1.0', 'decisions', false), (3, 2, 'm1.0', 'evidence', false), (4, 1, 'm1.0', 'tool_results', false),
 (5, 1, 'm1.0', 'artifacts', false), (7, 1, 'm1.0', 'evidence', false), (8, 1, 'm1.0', 'decisions', false), (9, 1, 'm1.0', 'decisions', false), (10, 1, 'm1.0', 'decisions', false)"""
_COVER = "(1, 0, array('m1.0')), (1, 1, array('m1.1')), (7, 0, array('m1.0')), (8, 5, array('m1.0')), (9, 0, array('m1.1')), (9, 1, array('m1.0')), (10, 0, array('m1.0'))"


@case("select * from (values (2, 'unknown_unit'), (3, 'repeated_unit'), (4, 'unrequested_section'), (5, 'wrong_origin'), (6, 'empty_plan'), (7, 'required_missing'), (8, 'bad_need'), (9, 'source_not_selected'), (10, 'need_uncovered')) v(h, code)")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection plans that break one rule each; the first is sound."""
    plan = values(spark, _PLAN, "handoff_id, rank, unit_id, section, essential").withColumn("handoff_id", F.col("handoff_id").cast("long"))
    cover = values(spark, _COVER, "handoff_id, need, unit_ids").withColumn("handoff_id", F.col("handoff_id").cast("long"))
    heads = spark.range(1, 11).withColumnRenamed("id", "handoff_id")
    units = _units_for(spark, heads)
    return se.check_plan(units, plan, cover, _CONTRACT, heads).select(F.col("handoff_id").cast("int").alias("h"), "code")


def _units_for(spark: SparkSession, heads: DataFrame) -> DataFrame:
    """The same small units for each of some handoffs."""
    ids = F.explode(F.array(*(F.struct(F.lit(u).alias("unit_id"), F.lit("m").alias("origin")) for u in ("m0.0", "m0.1", "m1.0", "m1.1"))))
    return heads.select("handoff_id", ids.alias("x")).select("handoff_id", "x.unit_id", "x.origin")


@query("""select conv_id, turn from conversations where turn % 4 <> 1 and turn % 4 <> 2""")
def unselected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("handoff_id"), F.col("turn").alias("unit_id"))
    out = se.unselected(c, c.where("unit_id % 4 = 1"), c.where("unit_id % 4 = 2"))
    return out.select(F.col("handoff_id").alias("conv_id"), F.col("unit_id").alias("turn"))


@case("select * from (values ('m1.0', 'm1.0'), ('m0.0', 'm0.2'), ('m0.1', 'm0.2'), ('m0.2', 'm0.2'), ('m1.1', 'm1.1')) v(unit_id, via)")
def plan_fit_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essentials first, then by rank what fits with all its context; what is shared is paid for once."""
    u = sp.source_units(_listing_frames(spark))
    plan = values(spark, "(1L, 1, 'm0.3', false), (1L, 2, 'm0.2', false), (1L, 3, 'm1.1', false), (1L, 4, 'm1.0', true)", "handoff_id, rank, unit_id, must")
    size = F.when(F.col("unit_id") == "m0.3", 90).when(F.col("unit_id").startswith("m0"), 10).otherwise(5)
    return se.fit_plan(plan, sp.closure(u), u.select("handoff_id", "unit_id", size.cast("long").alias("tokens")), 60).select("unit_id", "via")


_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query(rf"""with d as (select doc_id, text, regexp_split_to_array(text, '{_ENDS}') as ps from documents where doc_id is not null and not regexp_full_match(text, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*')),
s as (select doc_id, case when ps[-1] = '' then ps[:-2] else ps end as ls from d),
n as (select doc_id, ls, len(ls) as n, 1 + ((doc_id % len(ls)) + len(ls)) % len(ls) as k from s),
w as (select doc_id, ls, n, unnest([{{'f': null, 'l': null}}, {{'f': 1, 'l': k}}, {{'f': k, 'l': k}}, {{'f': k, 'l': n}}, {{'f': n + 1, 'l': n + 1}}, {{'f': n + 2, 'l': null}}], recursive := true) from n),
b as (select *, coalesce(f, 1) as a, coalesce(l, n) as b from w),
o as (select *, coalesce(max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) >= a, false) as hit from b)
select doc_id, a::int as first, b::int as last, case when (f is null) <> (l is null) then 'one_bound' when not (a >= 1 and b >= a and b <= n) then 'out_of_range' when regexp_full_match(array_to_string(ls[a:b], ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*') then 'blank' when hit then 'overlap' end as code from o""")
def excerpt_bounds_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six line ranges of every document, from its id and line count, with the rule that each breaks."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    return document_excerpts(spark, d)


def document_excerpts(spark: SparkSession, d: DataFrame) -> DataFrame:
    m = text_messages(d, F.col("doc_id"), F.lit(0), F.lit("user"), F.col("text"))
    src = se.whole_sources(m, spark.createDataFrame([], "handoff_id bigint, art_idx int, content_type string, content string"))
    n = F.col("n_lines").cast("long")
    k = 1 + F.pmod(F.col("handoff_id"), n)
    none = F.lit(None).cast("long")
    pairs = ((none, none), (F.lit(1), k), (k, k), (k, n), (n + 1, n + 1), (n + 2, none))
    ranges = F.array(*(F.struct(a.cast("long").alias("first"), b.cast("long").alias("last")) for a, b in pairs))
    w = src.select("handoff_id", "source_id", n.alias("of"), F.explode(ranges).alias("r")).select("handoff_id", "source_id", "of", "r.first", "r.last")
    out = se.excerpts(w, src)
    return out.select(F.col("handoff_id").alias("doc_id"), F.coalesce("first", F.lit(1)).cast("int").alias("first"), F.coalesce("last", "of").cast("int").alias("last"), "code")


# ---- evaluation

_SAMPLED = "select 'i' || c_custkey::varchar as instance_id, c_mktsegment as repo, (c_nationkey % 4)::varchar as difficulty from customer"


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("instance_id"), F.col("c_mktsegment").alias("repo"), (F.col("c_nationkey") % 4).cast("string").alias("difficulty"))


def _sample_sql(name: str, rows: str, n: int, seed: str) -> str:
    return f"""{name}_h as (select *, sha256('{seed}:' || instance_id) as h, sha256('{seed}:' || repo) as rh from {rows}),
{name}_f as (select instance_id from (select instance_id, row_number() over (order by rh) as o from (select *, row_number() over (partition by repo order by h) as k from {name}_h) where k = 1) where o <= {n}),
{name}_r as (select * from {name}_h where instance_id not in (select instance_id from {name}_f)),
{name}_q as (select repo, difficulty, count(*) as size, ({n} - (select count(*) from {name}_f)) as need, (select count(*) from {name}_r) as total from {name}_r group by 1, 2),
{name}_p as (select *, (need * size) // total as quota, row_number() over (order by (need * size) % total desc, repo, difficulty) as o, need - sum((need * size) // total) over () as spare from {name}_q),
{name} as (select instance_id from {name}_f union all select instance_id from (select r.instance_id, row_number() over (partition by r.repo, r.difficulty order by h) as k, quota + case when o <= spare then 1 else 0 end as most from {name}_r r join {name}_p using (repo, difficulty)) where k <= most)"""


@query(f"with base as ({_SAMPLED}), {_sample_sql('s', 'base', 40, 'seed')} select instance_id from s")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stratified(_instances(spark, sf_dir), 40, "seed").select("instance_id")


@query(f"""with base as ({_SAMPLED}), {_sample_sql('t', 'base', 30, 'seed:test')}, left1 as (select * from base where instance_id not in (select instance_id from t)), {_sample_sql('d', 'left1', 20, 'seed:dev')}
select instance_id, 'test' as split from t union all select instance_id, 'dev' from d""")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.splits(_instances(spark, sf_dir), "seed", {"test": 30, "dev": 20}).select("instance_id", "split")


_ANSWERS = """(1, '{"a":1,"b":["x","y"]}', 'a', 'equals', '1'), (1, '{"a":1,"b":["x","y"]}', 'b', 'contains_all', '["y","x"]'), (2, '{"a":true}', 'a', 'equals', '1'), (3, '{"a":1,"a":1}', 'a', 'equals', '1'), (4, '{"a":NaN}', 'a', 'equals', '1'), (5, '{"c":1}', 'a', 'equals', '1'), (6, '{"a":{"b":[1,2]}}', 'a.b', 'equals', '[1,2]')"""


@case("select * from (values (1, 2::bigint, 2::bigint, true), (2, 1, 0, false), (3, 1, 0, false), (4, 1, 0, false), (5, 1, 0, false), (6, 1, 1, true)) v(answer_id, n_checks, n_passed, success)")
def grade_equals_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.grade(values(spark, _ANSWERS, "answer_id, answer, check_path, operator, expected"))


_RUNS = "select role as condition, (turn % 2 = 0) as success, case when turn % 5 = 0 then null else length(text) end as tokens from conversations"


@query(f"select condition, count(*)::bigint as n, count(*) filter (success)::bigint as n_success, sum(coalesce(tokens, 0))::bigint as tokens, count(*) filter (tokens is null)::bigint as n_unknown, avg(tokens) as mean_tokens from ({_RUNS}) group by condition")
def suite_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return ev.suite_aggregate(c.select(F.col("role").alias("condition"), (F.col("turn") % 2 == 0).alias("success"), F.when(F.col("turn") % 5 != 0, F.length("text")).alias("tokens")))


@query("select event_type, median(value) as p50, quantile_disc(value, 0.95) as p_rank, count(*)::bigint as n from events where value is not null group by event_type")
def latency_p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.nearest_rank(table(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value")


@query("""select conv_id, case condition when 0 then 'full' when 1 then 'summary' else 'packet' end as condition, ((condition - conv_id) % 3 + 3)::int % 3 as turn from (select distinct conv_id from conversations), range(3) r(condition)""")
def cyclic_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").alias("idx")).distinct()
    return ev.cyclic(t, ("full", "summary", "packet")).select("conv_id", "condition", "turn")


@query("select item_id, (select count(*) from documents d where contains(d.text, b.probe))::bigint as n_texts from (select item_id, substring(text, 1, 60) as probe from benchmark) b")
def probe_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each benchmark passage whole. The SQL looks for its first 60 characters: it agrees where no document holds those alone."""
    p = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("probe"))
    n = ev.retention(table(spark, sf_dir, "documents").select("text"), p.select("probe").distinct())
    return p.join(n, "probe").select("item_id", "n_texts")


# ---- audit

_WIDE = "57 + strlen(to_json({})::varchar) + 9 + 2 + strlen(to_json(role)::varchar) + 2"


@query(f"""with d as (select conv_id, turn, role, text, row_number() over (partition by conv_id, role, text order by turn) as n from conversations),
o as (select conv_id, (ceil((93 + sum({_WIDE.format('text')}) + 2 * (count(*) - 1)) / 4) + 4)::bigint as original_tokens from d group by conv_id),
t as (select conv_id, (ceil((93 + coalesce(sum({_WIDE.format('text')}) filter (keep), 0) + 2 * greatest(count(*) filter (keep) - 1, 0)) / 4) + 4)::bigint as transmitted_tokens, count(*) filter (role <> 'system' and n > 1)::bigint as duplicates_removed,
 count(*) filter (role = 'system')::bigint as protected_messages, count(*) filter (not keep)::bigint as removed_messages from (select *, role = 'system' or (n = 1 and role = 'user') as keep from d) group by conv_id)
select conv_id, 'passed' as status, original_tokens, transmitted_tokens, protected_messages, duplicates_removed, removed_messages, greatest(original_tokens - transmitted_tokens, 0) as saved_tokens,
 round_even(greatest(original_tokens - transmitted_tokens, 0) * 100.0 / original_tokens, 1)::double as saved_percent from o join t using (conv_id)""")
def audit_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protect system turns, drop repeats, select the user's, and report."""
    f = conversation_frames(spark, sf_dir)
    f = f.with_(messages=f.messages.withColumn("tags", F.when(F.col("role") == "system", F.array(F.lit("constraint"))).otherwise(F.array().cast("array<string>"))))
    plain = conversation_frames(spark, sf_dir)
    done = run_policies(f, [po.preserve(), po.deduplicate(), po.select(roles=["user"])])
    done = done.with_(messages=done.messages.withColumn("tags", F.array().cast("array<string>")))
    r = reports(plain, done)
    return r.select(F.col("handoff_id").alias("conv_id"), "status", "original_tokens", "transmitted_tokens", "protected_messages", "duplicates_removed", "removed_messages", "saved_tokens", F.col("saved_percent").cast("double").alias("saved_percent"))


_KEY, _MAIL = r"\b(?:sk-[A-Za-z0-9_-]{8,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,})\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_TEL = r"(?:\+|\b)\d[\d ()-]{7,}\d\b"


@query(f"""with a as (select conv_id, turn, role, text, regexp_replace(text, '{_KEY}', '[REDACTED:api_key]', 'g') as t1, len(regexp_extract_all(text, '{_KEY}')) as n1 from conversations),
b as (select *, regexp_replace(t1, '{_MAIL}', '[REDACTED:email]', 'g') as t2, len(regexp_extract_all(t1, '{_MAIL}')) as n2 from a),
c as (select *, regexp_replace(t2, '{_TEL}', '[REDACTED:phone]', 'g') as t3, n1 + n2 + len(regexp_extract_all(t2, '{_TEL}')) as n, row_number() over (partition by conv_id, role, text order by turn) as k from b),
d as (select *, k = 1 and role in ('user', 'assistant') as picked, {_WIDE.format('t3')} as bytes from c),
e as (select *, case when picked then sum(case when picked then bytes + 2 else 0 end) over (partition by conv_id order by turn desc) - 2 end as upto from d),
f as (select *, picked and ceil((93 + upto) / 4) + 4 <= 800 as sent from e),
g as (select conv_id, (ceil((93 + sum({_WIDE.format('text')}) + 2 * (count(*) - 1)) / 4) + 4)::bigint as original_tokens, (ceil((93 + coalesce(sum(bytes) filter (sent), 0) + 2 * greatest(count(*) filter (sent) - 1, 0)) / 4) + 4)::bigint as transmitted_tokens, sum(n)::bigint as redactions,
 count(*) filter (k > 1)::bigint as duplicates_removed, count(*) filter (not sent)::bigint as removed_messages from f group by conv_id)
select conv_id as handoff_id, 'sender' as sender, 'receiver' as receiver, original_tokens, redactions, duplicates_removed, 0::bigint as protected_messages, removed_messages, 0::bigint as summarizer_input_tokens, 0::bigint as summarizer_output_tokens, null::varchar as failure_code, null::varchar as failed_policy,
 transmitted_tokens, 'passed' as status, greatest(original_tokens - transmitted_tokens, 0) as saved_tokens, round_even(greatest(original_tokens - transmitted_tokens, 0) * 100.0 / original_tokens, 1)::double as saved_percent, original_tokens - transmitted_tokens as net_saved_tokens from g""")
def policy_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies in order, with the reports."""
    f = conversation_frames(spark, sf_dir)
    chain = [po.preserve(), redact(["api_key", "email", "phone"], keep_source=True), po.deduplicate(), po.select(roles=["user", "assistant"]), redact(["email"], stage="egress"), po.budget(800)]
    return reports(f, run_policies(f, chain)).drop("events").withColumn("saved_percent", F.col("saved_percent").cast("double"))
