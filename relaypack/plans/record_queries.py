"""Queries: evaluation records, payloads, deliveries. Conversations stand in for observations, each turn one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.operators import payloads as pl
from relaypack.operators import records as rc
from relaypack.operators import spans as sp
from relaypack.operators.compiler import Contract
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


# Input columns, as SQL that Spark and DuckDB read alike; the rules below are told to each in its own way.
_COND = "case turn % 3 when 0 then 'full' when 1 then 'naive_summary' else 'packet' end"
_OBS = {
    "conv_id": "conv_id", "turn": "turn", "condition": _COND, "summary_failed": f"({_COND}) = 'naive_summary' and length(text) % 11 = 0", "provider_failed": "length(text) % 7 = 0", "parsed": "length(text) % 5 <> 0",
    "accepted": "case when length(text) % 13 = 0 then null else length(text) % 4 <> 0 end", "n": "length(text)",
}


def _from(columns: dict[str, str]) -> str:
    return "select " + ", ".join(f"{x} as {n}" for n, x in columns.items()) + " from conversations"


def _rows(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*(f"{x} as {n}" for n, x in columns.items()))


_STATUS = "case when summary_failed then 'summary_error' when provider_failed then 'provider_error' when not parsed then 'invalid_output' when accepted is null then 'acceptance_error' else 'completed' end"


@query(f"select conv_id, turn, {_STATUS} as status from ({_from(_OBS)})")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _OBS).select("conv_id", "turn", rc.status().alias("status"))


_RECORD = {
    "conv_id": "conv_id", "turn": "turn", "condition": _COND, "status": "case when length(text) % 11 = 0 then 'summary_error' when length(text) % 7 = 0 then 'provider_error' when length(text) % 5 = 0 then 'invalid_output' else 'completed' end",
    "retry_count": "length(text) % 4", "event_count": "3 + length(text) % 2 - turn % 2", "preparation_tokens": f"case when ({_COND}) = 'naive_summary' or length(text) % 17 = 0 then length(text) end", "receiver_input": "case when length(text) % 11 <> 0 and length(text) % 19 <> 0 then text end",
    "handoff_tokens": "case when length(text) % 11 <> 0 then length(text) end", "grade": "case when length(text) % 7 <> 0 and length(text) % 11 <> 0 or length(text) % 23 = 0 then length(text) % 3 <> 0 end", "error": "case when length(text) % 7 = 0 or length(text) % 11 = 0 or length(text) % 29 = 0 then 'e' end",
    "raw_output": "case when length(text) % 31 <> 0 then text end", "response_id": "case when length(text) % 37 <> 0 then 'r' end", "input_tokens": "case when length(text) % 41 <> 0 then 1 end", "output_tokens": "case when length(text) % 43 <> 0 then 1 end", "total_tokens": "case when length(text) % 41 <> 0 then 2 end",
}
_WHOLE = "(input_tokens is not null and output_tokens is not null and total_tokens is not null)"


@query(f"""select conv_id, turn, case when not {_WHOLE} and coalesce(input_tokens, output_tokens, total_tokens) is not null then 'partial_usage' when retry_count > event_count then 'retries_over_events'
 when condition <> 'naive_summary' and preparation_tokens is not null then 'preparation_of_other' when condition = 'naive_summary' and status <> 'summary_error' and preparation_tokens is null then 'preparation_missing'
 when status = 'summary_error' and condition <> 'naive_summary' then 'summary_error_of_other' when status = 'summary_error' and (receiver_input is not null or handoff_tokens is not null or grade is not null) then 'summary_error_claims'
 when status in ('summary_error', 'provider_error') and error is null then 'error_missing' when status <> 'summary_error' and (receiver_input is null or handoff_tokens is null) then 'input_missing'
 when status in ('completed', 'invalid_output') and (raw_output is null or grade is null or not {_WHOLE} or response_id is null) then 'evidence_missing' when status = 'completed' and error is not null then 'error_of_completed'
 when status = 'provider_error' and grade is not null then 'grade_of_error' when status <> 'completed' and grade then 'success_of_failed' end as code from ({_from(_RECORD)})""")
def record_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each record breaks."""
    return _rows(spark, sf_dir, _RECORD).select("conv_id", "turn", rc.broken_rule().alias("code"))


_ERR = {"conv_id": "conv_id", "turn": "turn", "error_class": "case length(text) % 9 when 0 then 'RateLimitError' when 1 then 'APIStatusError' when 2 then 'ModelRefusalError' when 3 then 'TimeoutError' when 4 then 'ProviderProtocolError' when 5 then 'KeyError' when 6 then 'APIConnectionError' when 7 then 'MaxTurnsExceeded' else 'APITimeoutError' end", "status_code": "400 + length(text) % 150"}


@query(f"""select conv_id, turn, m.category, case when error_class = 'APIStatusError' then status_code end::bigint as status_code, case when m.again is null then error_class = 'APIStatusError' and status_code >= 500 else m.again end as retryable from ({_from(_ERR)})
left join (values ('RateLimitError', 'rate_limit', true), ('APIStatusError', 'provider_http', null), ('ModelRefusalError', 'model_refusal', false), ('TimeoutError', 'case_timeout', true), ('ProviderProtocolError', 'protocol_error', false), ('KeyError', 'provider_error', false),
 ('APIConnectionError', 'provider_connection', true), ('MaxTurnsExceeded', 'max_turns', false), ('APITimeoutError', 'provider_timeout', true)) m(name, category, again) on name = error_class""")
def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rows(spark, sf_dir, _ERR).withColumn("e", rc.provider_error())
    return out.select("conv_id", "turn", "e.category", F.col("e.status_code").cast("long").alias("status_code"), "e.retryable")


@query(f"select conv_id as task_id, count(*)::bigint as n, count(*) = 3 and count(distinct condition) = 3 as ok from ({_from(_OBS)}) group by conv_id")
def task_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with each condition exactly once."""
    r = _rows(spark, sf_dir, _OBS).withColumnRenamed("conv_id", "task_id")
    return rc.tasks_of(r, r.select("task_id").distinct(), ("full", "naive_summary", "packet"))


_GRADED = {"task_id": "conv_id", "condition": "case turn when 0 then 'full' when 1 then 'packet' when 2 then 'gold_control' else 'unchanged_control' end", "patch": "case when length(text) % 4 = 0 then '' else text end", "resolved": "case when length(text) % 6 = 0 then null else length(text) % 5 > 2 end", "turn": "turn"}
_GRID = f"""g as (select * from ({_from(_GRADED)}) where turn < 4), t as (select distinct conv_id as task_id from conversations),
o as (select t.task_id, c as condition, patch, resolved, c not like '%control' and coalesce(patch, '') = '' as none from t cross join (values ('full'), ('packet'), ('gold_control'), ('unchanged_control')) v(c) left join g on g.task_id = t.task_id and g.condition = c)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _rows(spark, sf_dir, _GRADED).where("turn < 4")
    return rc.outcomes(g.select("task_id").distinct(), g, g, ("full", "packet"))


@query(f"with {_GRID} select task_id, condition, case when none then 'no_candidate_patch' when resolved is null then 'upstream_evaluation_error' else 'graded' end as status, case when none then false else resolved end as resolved from o")
def prediction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query(f"with {_GRID} select task_id, count(*) filter (condition = 'gold_control' and resolved) = 1 and count(*) filter (condition = 'unchanged_control' and not resolved) = 1 as valid from o group by task_id")
def control_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.controls_valid(_outcomes(spark, sf_dir))


_SPLIT = "case when c_custkey % 10 < 3 then 'test' else 'development' end"


@query(f"with r as (select {_SPLIT} as split, c_mktsegment as repo, (c_nationkey % 4)::varchar as difficulty from customer) select split, 'repo' as field, repo as value, count(*)::bigint as n from r group by 1, 3 union all select split, 'difficulty', difficulty, count(*) from r group by 1, 3")
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr(f"{_SPLIT} as split", "c_mktsegment as repo", "cast(c_nationkey % 4 as string) as difficulty")
    return rc.distribution(c)


_SUM = {"condition": _COND, "resolved": "case when length(text) % 6 = 0 then null else length(text) % 5 > 2 end", "status": "case when length(text) % 7 = 0 then 'failed_before_grading' else 'candidate_generated' end", "handoff_tokens": "case when length(text) % 5 <> 0 then length(text) end", "model_calls": "turn", "preparation_calls": "case when turn % 2 = 0 then 1 end", "tool_steps": "case when length(text) % 3 <> 0 then length(text) % 10 end", "budget": "8"}


@query(f"""select condition, count(*)::bigint as tasks, count(*) filter (resolved)::bigint as resolved, count(*) filter (resolved is null)::bigint as upstream_errors, count(*) filter (status = 'candidate_generated')::bigint as candidate_patches, count(*) filter (status = 'failed_before_grading')::bigint as failed_before_grading,
 count(handoff_tokens)::bigint as packets_measured, round(avg(handoff_tokens), 1) as mean_handoff_tokens, sum(model_calls)::bigint as model_calls, sum(coalesce(preparation_calls, case when status = 'failed_before_grading' then model_calls else 0 end))::bigint as preparation_calls,
 sum(coalesce(tool_steps, 0))::bigint as tool_actions, count(*) filter (tool_steps >= budget)::bigint as continuations_at_budget from ({_from(_SUM)}) group by condition""")
def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.condition_summary(_rows(spark, sf_dir, _SUM))


@query("select conv_id, turn, length(text) % 3 = 0 and turn % 2 = 0 or (turn % 2 = 1 and length(text) % 3 = 1) as success, case when turn % 2 = 0 and length(text) % 3 <> 0 then '{\"success\":true,\"checks\":' || turn || '}' end as original_grading, case when turn % 2 = 0 and length(text) % 3 <> 0 then 'r2' end as grading_revision from conversations")
def regraded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns said success and are graded anew; odd ones have no new grade."""
    old = _rows(spark, sf_dir, {"conv_id": "conv_id", "turn": "turn", "success": "turn % 2 = 0 or length(text) % 3 = 1", "checks": "turn"})
    new = _rows(spark, sf_dir, {"conv_id": "conv_id", "turn": "turn", "success": "length(text) % 3 = 0", "checks": "turn"}).where("turn % 2 = 0")
    return rc.regrade(old, new, ["conv_id", "turn"], ["success", "checks"], revision="r2").drop("checks")


@query("select conv_id as run_id, count(*) filter (turn = 0 and role <> 'user') = 0 and count(*) % 2 = 0 as same from conversations group by conv_id")
def resume_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose stored configuration equals the wanted one in two fields, one of them null in both."""
    c = table(spark, sf_dir, "conversations")
    stored = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("turn") == 0) & (F.col("role") != "user")).alias("other")).selectExpr("run_id", "cast(n % 2 as int) as a", "cast(other as int) as b", "cast(null as string) as c")
    wanted = stored.selectExpr("run_id", "0 as a", "0 as b", "cast(null as string) as c")
    return rc.same_configuration(stored, wanted, ("a", "b", "c"))


@query("select conv_id, turn from conversations where turn % 3 <> 1")
def runs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return rc.still_to_run(c, c.where("turn % 3 = 1").unionAll(c.where("turn = 1")), ["conv_id", "turn"])


@query("""select conv_id as task_id, turn::int + 1 as line_no, 'observation' as kind, null::bigint as n, '{"idx":' || turn || ',"role":' || to_json(role) || '}' as record from conversations
union all select conv_id, 0, 'run_started', null, null from conversations group by conv_id union all select conv_id, count(*)::int + 1, 'run_completed', count(*), null from conversations group by conv_id""")
def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a run's stream: header, observations, footer."""
    return rc.run_stream(table(spark, sf_dir, "conversations").selectExpr("conv_id as task_id", "turn as idx", "role"))


@query("select conv_id as task_id, count(*) filter (length(text) % 50 = 0) = 0 as whole from conversations group by conv_id")
def runs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that lost a line aren't whole."""
    c = table(spark, sf_dir, "conversations")
    stream = rc.run_stream(c.selectExpr("conv_id as task_id", "turn as idx", "length(text) as n_chars"))
    return rc.whole_runs(stream.where("not coalesce(cast(get_json_object(record, '$.n_chars') as int) % 50 = 0, false)"))


_CAND = """case length(text) % 4 when 0 then '{"summary": 1, "files": 2}' when 1 then '{"files": 1}' when 2 then '[1]' else '{"files": "' || repeat('x', 200) || '", "summary": 1}' end"""


@query("select conv_id, turn, case length(text) % 4 when 1 then 'wrong_keys' when 2 then 'not_an_object' when 3 then 'too_large' end as code from conversations")
def candidate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_CAND} as answer")
    return c.select("conv_id", "turn", rc.exact_object(F.col("answer"), ("files", "summary"), 120).alias("code"))


_ACTION = "{{\"operation\": \"{0}\", \"path\": \"p\", \"query\": \"\", \"old\": \"\", \"new\": \"\", \"note\": \"\", \"start\": {1}, \"end\": 2}}"


@query("select conv_id, turn, case when length(text) % 5 = 0 then 1 when length(text) % 5 = 1 then 2 when length(text) % 5 = 2 and turn % 2 = 0 then 1 end::int as n_actions from conversations")
def source_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenated actions: one, two, an edit (for writers only), a number as text, none."""
    one, edit, wrong = _ACTION.format("read", 1), _ACTION.format("edit", 1), _ACTION.format("read", '"1"')
    text = f"case length(text) % 5 when 0 then '{one}' when 1 then '{one} {one}' when 2 then '{edit}' when 3 then '{wrong}' else '' end"
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{text} as actions", "turn % 2 = 0 as writable")
    return c.select("conv_id", "turn", F.json_array_length(rc.parse_actions("actions", "writable")).alias("n_actions"))


@query("select doc_id, len(string_split(text, ' the ')) - 1 = 1 as once from documents where text is not null")
def single_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a piece to be edited occurs exactly once."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", rc.single_edit(F.col("text"), F.lit(" the ")).alias("once"))


@query("""select conv_id, case when count(*) > 6 then 'task_count' when conv_id % 5 = 0 then 'candidate_count' when count(distinct role) <> count(*) then 'repeated_condition' when conv_id % 3 = 0 then 'path_outside' end as code from conversations group by conv_id""")
def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("conditions"))
    tasks = F.when(F.size("conditions") > 6, F.sequence(F.lit(1), F.lit(11))).otherwise(F.array(F.lit(1)))
    paths = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a/b.py"), F.lit("a/../../b"))).otherwise(F.array(F.lit("a/b..py")))
    return c.select("conv_id", "conditions", tasks.alias("tasks"), paths.alias("paths"), F.when(F.col("conv_id") % 5 == 0, 4).otherwise(3).alias("candidates")).select("conv_id", rc.broken_request().alias("code"))


# ---- payloads


@query("select conv_id, turn, case when length(text) % 2 = 0 then '{\"a\":1,\"b\":[2,\"x\"]}' else '{\"a\": 1}' end as metadata_json from conversations")
def reserved_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forged references go from the metadata of half the messages; the others' stays as it was written."""
    m = "case when length(text) % 2 = 0 then '{\"a\": 1, \"relaypack.source_ids\": [\"m0\"], \"b\": [2, \"x\"], \"relaypack.item\": \"e0\"}' else '{\"a\": 1}' end"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{m} as m").select("conv_id", "turn", pl.stripped(F.col("m")).alias("metadata_json"))


@query("with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as k from (select doc_id, string_split(case when text like '%' || chr(10) then text[:-2] else text end, chr(10)) as ls from documents where text <> '' and not regexp_matches(text, '[\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]'))) select doc_id, md5(string_agg(k || ': ' || line, chr(10) order by k)) as digest from l group by doc_id")
def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of the documents of plain line ends."""
    d = table(spark, sf_dir, "documents").where("text <> ''").where(~F.col("text").rlike("[\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"))
    return d.select("doc_id", F.md5(pl.numbered(F.col("text"))).alias("digest"))


_PREFIX = "'Goal:' || chr(10) || 'g' || conv_id || chr(10) || chr(10) || 'Receiver instruction:' || chr(10) || role || chr(10) || chr(10) || 'Receiver output contract:' || chr(10) || '{}'"


def _prefix() -> Column:
    return pl.task_prefix(F.concat(F.lit("g"), F.col("conv_id").cast("string")), F.col("role"), F.lit("{}"))


@query(f"select conv_id, turn, md5(x) as digest, ceil(strlen(x) / 4)::bigint as tokens from (select conv_id, turn, {_PREFIX} || chr(10) || chr(10) || '<sender_context>' || chr(10) || text || chr(10) || '</sender_context>' as x from conversations)")
def receiver_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("x", pl.receiver_input(_prefix(), F.col("text")))
    return c.select("conv_id", "turn", F.md5("x").alias("digest"), pl.estimate(F.col("x")).cast("long").alias("tokens"))


_CONTRACT = Contract("g", ("decisions",), ("evidence", "artifacts"), 300)
_ASK = "Write a summary of the sender''s state for the agent that goes on. Do not do its task.' || chr(10) || 'Keep the facts it needs and add none. Plain text, 300 tokens at most.' || chr(10) || chr(10) || 'Its task, quoted as a JSON string:"


@query(f"select conv_id, turn, md5('{_ASK}' || chr(10) || to_json({_PREFIX})::varchar || chr(10) || chr(10) || 'Required sections: decisions' || chr(10) || 'Preferred sections: evidence, artifacts' || chr(10) || chr(10) || 'Sender''s state:' || chr(10) || text) as digest from conversations")
def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(pl.summary_prompt(_CONTRACT, _prefix(), F.col("text"))).alias("digest"))


@query("select conv_id, turn, md5(case turn % 3 when 0 then '{\"goal\":\"g\",\"sender_state\":[' || turn || ']}' when 1 then '{\"goal\":\"g\",\"summary\":' || to_json(text)::varchar || '}' else case when conv_id % 2 = 0 then '{\"goal\":\"g\"}' end end) as digest from conversations")
def goal_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The goal with a history, a summary or a packet; a packet of another goal gives none."""
    condition = "case turn % 3 when 0 then 'full' when 1 then 'summary' else 'packet' end"
    context = "case turn % 3 when 0 then concat('[', turn, ']') when 1 then text else case when conv_id % 2 = 0 then '{\"goal\":\"g\"}' else '{\"goal\":\"h\"}' end end"
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{condition} as c", f"{context} as x")
    return c.select("conv_id", "turn", F.md5(pl.goal_context(F.col("c"), F.col("x"), F.lit("g"))).alias("digest"))


@query("select c_mktsegment as repo, 'i' || c_custkey as instance_id, md5(c_name) as base_commit, c_name as problem_statement from customer")
def public_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_mktsegment as repo", "concat('i', c_custkey) as instance_id", "md5(c_name) as base_commit", "c_name as problem_statement", "c_acctbal as patch", "c_nationkey as hidden_tests")
    return pl.public_tasks(c)


_UNITS = "select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from conversations"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = sp.source_units(conversation_frames(spark, sf_dir))
    # every line but the first of a message needs the one before
    u = u.withColumn("context", F.when(F.col("part") > 0, F.array(F.concat(F.lit("m"), F.col("idx").cast("string"), F.lit("."), (F.col("part") - 1).cast("string")))).otherwise(F.array().cast("array<string>")))
    return pl.indexed_units(u)


@query(f"""with u as (select conv_id, turn, row_number() over (partition by conv_id, turn order by k) - 1 as part, row_number() over (partition by conv_id order by turn, k) - 1 as unit_index, dense_rank() over (partition by conv_id order by turn) - 1 as source from ({_UNITS}) where trim(line, E' \\t') <> '')
select conv_id, unit_index::int as unit_index, source::int as source, 'm' || turn || '.' || part as unit_id, case when part > 0 then (unit_index - 1)::varchar else '' end as context from u""")
def indexed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each conversation by number, with shared origins."""
    return _indexed(spark, sf_dir).select(F.col("handoff_id").alias("conv_id"), "unit_index", "source", "unit_id", F.array_join(F.transform("context_indices", lambda x: x.cast("string")), ",").alias("context"))


@query(f"""with u as (select conv_id, count(*) as n from ({_UNITS}) where trim(line, E' \\t') <> '' group by conv_id)
select conv_id, case when conv_id % 4 = 0 then 'bad_unit' when conv_id % 4 = 1 then 'bad_need' end as code from u where conv_id % 4 < 2""")
def indexed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by number, a quarter with a unit that isn't there, a quarter with a need that isn't."""
    x = _indexed(spark, sf_dir)
    n = x.groupBy("handoff_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    other = F.when(F.col("handoff_id") % 4 == 0, F.col("n")).otherwise(0).cast("int")
    need = F.when(F.col("handoff_id") % 4 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    plan = n.select("handoff_id", F.lit(1).alias("rank"), other.alias("unit_index"), F.lit("evidence").alias("section"), F.lit(True).alias("essential"), need.alias("needs"))
    return pl.indexed_plan(plan, x, 2)[2].select(F.col("handoff_id").alias("conv_id"), "code")


@query("""select conv_id, turn, md5('[{"role":"user","content":' || to_json(text)::varchar || '}]') as history, md5('{"handoff_packet":' || to_json(text)::varchar || ',"messages":[{"role":"user","content":' || to_json(text)::varchar || '}]}') as update, role as goto from conversations""")
def packet_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as packets, delivered to a run's history and to a graph's state."""
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("handoff_id"), F.col("role").alias("receiver"), "text")
    return pl.delivery(c).select("handoff_id.conv_id", "handoff_id.turn", F.md5("history").alias("history"), F.md5("update").alias("update"), "goto")


@query("""with i as (select conv_id, turn, text, case when turn < 2 then 'history' when turn < 4 then 'pre_handoff' else 'input' end as segment, '{"turn":' || turn || '}' as item from conversations),
s as (select conv_id, segment, case when segment = 'history' and count(*) = 1 then to_json(any_value(text))::varchar else '[' || string_agg(item, ',' order by turn) || ']' end as body from i group by 1, 2)
select conv_id, md5(coalesce(max(body) filter (segment = 'history'), '[]')) as history, coalesce(max(body) filter (segment = 'pre_handoff'), '[]') as pre_handoff, coalesce(max(body) filter (segment = 'input'), '[]') as input from s group by conv_id""")
def rebuilt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut in three segments and rebuilt; a history of one text goes back as that text."""
    segment = "case when turn < 2 then 'history' when turn < 4 then 'pre_handoff' when turn = 5 then 'elsewhere' else 'input' end"
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id as handoff_id", f"{segment} as segment", "turn as source_index", "0 as part", "concat('{\"turn\":', turn, '}') as item", "text as content", "turn < 2 as was_string")
    return pl.segments(c).select(F.col("handoff_id").alias("conv_id"), F.md5("history").alias("history"), "pre_handoff", "input")
