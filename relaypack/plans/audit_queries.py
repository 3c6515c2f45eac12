"""Queries: the audit trail, counters, typed objects, runtimes' histories, fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.operators import audit, counters
from relaypack.operators import policies as po
from relaypack.operators.compiler import Contract
from relaypack.operators.frames import frames, text_messages
from relaypack.operators.redact import redact
from relaypack.plans import history
from relaypack.plans.common import conversation_frames, table
from relaypack.plans.pipeline import reports, run_policies
from relaypack.plans.text_queries import Query
from relaypack.sources import fixtures

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _versioned(policy, version: str):
    policy.version = version
    return policy


@query("""with d as (select conv_id, turn, role, row_number() over (partition by conv_id, role, text order by turn) as n from conversations)
select conv_id, 'preserve' as policy, 'protected' as action, '1' as policy_version, 0::bigint as n from conversations group by conv_id
union all select conv_id, 'deduplicate', 'duplicates_removed', '7', count(*) filter (n > 1) from d group by conv_id union all select conv_id, 'select', 'selected', '2024-05', count(*) filter (n = 1 and role <> 'user') from d group by conv_id""")
def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three policies with the versions of these."""
    chain = [po.preserve(), _versioned(po.deduplicate(), "7"), _versioned(po.select(roles=["user"]), "2024-05")]
    e = audit.stamped(run_policies(conversation_frames(spark, sf_dir), chain).events, chain)
    return e.select(F.col("handoff_id").alias("conv_id"), "policy", "action", "policy_version", F.col("count").alias("n"))


_REPORTED = """select conv_id, case when conv_id % 4 = 0 or conv_id % 3 = 0 then 'denied' else 'passed' end as status, case when conv_id % 4 = 0 then 'budget_exceeded' when conv_id % 3 = 0 then 'audit_export' end as failure_code,
 case when conv_id % 3 = 0 or conv_id % 4 = 0 then 0 else 10 end::bigint as transmitted_tokens, case when conv_id % 3 = 0 then 2 else 0 end::int as n_warnings, conv_id % 2 = 1 as due from (select distinct conv_id from conversations)"""


@query(_REPORTED)
def report_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of which half are written already, a third has two reporters that fail and a quarter was denied before."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("handoff_id")).distinct()
    denied = F.col("handoff_id") % 4 == 0
    r = c.select("handoff_id", F.when(denied, "denied").otherwise("passed").alias("status"), F.when(denied, "budget_exceeded").alias("failure_code"), F.when(denied, "budget").alias("failed_policy"), F.when(denied, 0).otherwise(10).cast("long").alias("transmitted_tokens"))
    failed = c.where("handoff_id % 3 = 0").select("handoff_id", F.explode(F.array(F.lit("mail"), F.lit("disk"), F.lit("mail"))).alias("reporter"))
    due, final = audit.emission(spark, r, c.where("handoff_id % 2 = 0"), failed)
    out = final.join(due.select("handoff_id", F.lit(True).alias("due")), "handoff_id", "left")
    return out.select(F.col("handoff_id").alias("conv_id"), "status", "failure_code", "transmitted_tokens", F.size("warnings").alias("n_warnings"), F.coalesce("due", F.lit(False)).alias("due"))


@query("""select conv_id, case when s > 0 and a > 0 then 'pipeline_output' else 'sender_state' end as stage, case when s > 0 and a > 0 then 'constraints: a policy removed it;decisions: a policy removed it' else
 'constraints: ' || case when s > 0 and a > 0 then '' else 'send a message of kind constraints or begin a text with Constraint:' end || ';decisions: send a message of kind decisions or begin a text with Decision:' end as hints
from (select conv_id, count(*) filter (role = 'system') as s, count(*) filter (role = 'assistant') as a, count(*) filter (role = 'user') as u from conversations group by conv_id)""")
def missing_state_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints and decisions are gone from every conversation; a policy took them where both were there."""
    c = table(spark, sf_dir, "conversations")
    section = F.when(F.col("role") == "system", "constraints").when(F.col("role") == "assistant", "decisions").otherwise("evidence")
    before = c.groupBy(F.col("conv_id").alias("handoff_id"), section.alias("section")).agg(F.count(F.lit(1)).alias("n"))
    out = audit.hints(Contract("g", ("constraints", "decisions")), before, before.where("section = 'evidence'"))
    return out.select(F.col("handoff_id").alias("conv_id"), "stage", F.array_join("hints", ";").alias("hints"))


@query("""select conv_id, 'sections (sender_state): ' || case when s + u > 0 then case when s > 0 then 'constraints=' || s else '' end || case when s > 0 and u > 0 then ', ' else '' end || case when u > 0 then 'evidence=' || u else '' end else 'none' end || chr(10)
 || 'unclassified messages (from 0): ' || coalesce(x, 'none') || chr(10) || 'decisions: add one' as text from (select conv_id, count(*) filter (role = 'system') as s, count(*) filter (role = 'user') as u, string_agg(turn::varchar, ', ' order by turn) filter (role = 'assistant') as x from conversations group by conv_id)""")
def diagnostics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "system").alias("s"), F.count_if(F.col("role") == "user").alias("u"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn")))).alias("unclassified_indices"),
    )
    rows = c.select("conv_id", F.lit("sender_state").alias("stage"), F.create_map(F.lit("evidence"), "u", F.lit("constraints"), "s").alias("section_counts"), "unclassified_indices", F.array(F.lit("decisions: add one")).alias("hints"))
    return rows.select("conv_id", audit.diagnostics_text().alias("text"))


_HMAC_KEY = b"key of this run"
_PADDED = _HMAC_KEY.ljust(64, b"\0")


@query(f"select conv_id, turn, sha256(unhex('{bytes(x ^ 0x5C for x in _PADDED).hex()}') || unhex(sha256(unhex('{bytes(x ^ 0x36 for x in _PADDED).hex()}') || encode(text)))) as fingerprint from conversations")
def keyed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HMAC-SHA-256 of every text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", audit.keyed(F.col("text"), _HMAC_KEY).alias("fingerprint"))


@query("select conv_id, '' as failed from conversations group by conv_id")
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No report of a chain of policies breaks a condition."""
    f = conversation_frames(spark, sf_dir)
    r = reports(f, run_policies(f, [po.preserve(), redact(["email"]), po.deduplicate(), po.budget(300)]))
    return audit.failed_checks(r).select(F.col("handoff_id").alias("conv_id"), F.array_join("failed", ",").alias("failed"))


@query("select count(*)::bigint as n, count(*) filter (regexp_matches(text, '@'))::bigint as hits, (select count(*) from documents where doc_id is not null and not regexp_matches(text, '@') and regexp_matches(text, '\\d'))::bigint as n_clean, 0::bigint as false_positives, (count(*) filter (regexp_matches(text, '@')))::double / count(*) as recall from documents where doc_id is not null and regexp_matches(text, '[A-Za-z0-9]@[a-z0-9]+\\.[a-z]')")
def detector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an address, and those with figures but no address, against what the detector changes."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    f = redact(["email"])(frames(spark, d.selectExpr("doc_id as handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json"), text_messages(d, F.col("doc_id"), F.lit(0), F.lit("user"), F.col("text"))))
    found = f.events.where("action = 'redacted' and count > 0").select(F.col("handoff_id").alias("id"))
    planted = d.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]")).select(F.col("doc_id").alias("id"))
    clean = d.where(~F.col("text").rlike("@") & F.col("text").rlike(r"\d")).select(F.col("doc_id").alias("id"))
    return audit.recall(found, planted, clean)


@query("select conv_id, turn, true as same from conversations")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the messages, dealt otherwise, say the same."""
    f = conversation_frames(spark, sf_dir)
    one = redact(["email", "phone"])(f).messages
    two = redact(["email", "phone"])(f.with_(messages=f.messages.repartition(7, "content"))).messages
    key = F.struct("handoff_id", "msg_idx").alias("k")
    out = audit.repeatable(one.select(key, "content"), two.select(key, "content"), "k", "content")
    return out.select(F.col("k.handoff_id").alias("conv_id"), F.col("k.msg_idx").cast("long").alias("turn"), "same")


@query("""select '| event | n |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) order by event_type) as "table" from (select event_type, count(*) as n from events group by 1)""")
def readme_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.readme_table(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), (("event", "event_type"), ("n", "n")), "event_type")


_OBJECT = """case case when conv_id % 2 = 1 and turn % 4 in (1, 2) then 0 else turn % 4 end when 0 then '{"id":' || turn || ',"name":"x","more":[1]}' when 1 then '{"id":"1","name":"x"}' when 2 then '{"name":"x"}' else '{"id":1,"name":null,"score":2}' end"""


@query("""select conv_id, turn, case when turn % 4 = 3 then '{"id":1,"name":null,"score":2}' else '{"id":' || turn || ',"name":"x"}' end as content from conversations c
where not exists (select 1 from conversations d where d.conv_id = c.conv_id and d.turn % 4 in (1, 2) and d.conv_id % 2 = 0)""")
def schema_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects against a typed schema. Even conversations have objects of a wrong type or without a required field, which deny them."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_OBJECT} as o")
    m = text_messages(c, F.col("conv_id"), F.col("turn"), F.lit("user"), F.col("o"), kind=F.lit("structured")).withColumn("content_type", F.lit("object"))
    heads = c.selectExpr("conv_id as handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json").distinct()
    f = po.typed("id bigint not null, name string, score double")(frames(spark, heads, m))
    return f.messages.select(F.col("handoff_id").alias("conv_id"), F.col("msg_idx").cast("long").alias("turn"), "content")


@query("""select conv_id, ceil(strlen(p) / 4)::bigint as packet_tokens, md5('[{"role":"user","content":' || to_json(p)::varchar || '}]') as history from (select conv_id,
 '{"artifacts":[],"completed_work":[],"constraints":[],"decisions":[' || string_agg('{"content":' || to_json(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::varchar || ',"kind":"decisions","role":"assistant"}', ',' order by turn) filter (role = 'assistant') || '],"evidence":[],"failed_attempts":[],"goal":"Go on","pending_work":[],"receiver":"r","sender":"s","tool_results":[]}' as p
 from conversations where conv_id % 5 <> 0 group by conv_id having count(*) filter (role = 'assistant') > 0)""")
def snapshot_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run snapshots compiled and delivered; every fifth has a call without its output, which denies it."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("Decision: "), F.col("text"))).otherwise(F.col("text"))
    item = F.to_json(F.struct(F.lit("message").alias("type"), "role", text.alias("content")))
    s = c.groupBy(F.col("conv_id").alias("handoff_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("history"))
    call = F.array(F.lit('{"type":"function_call","call_id":"c","name":"f","arguments":"{}"}'))
    none = F.array().cast("array<string>")
    s = s.withColumns({"pre_items": none, "input_items": F.when(F.col("handoff_id") % 5 == 0, call).otherwise(none), "new_items": none})
    heads = s.selectExpr("handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json")
    out, sent = history.compile_snapshots(spark, heads, s, Contract("Go on", ("decisions",), (), 4000))
    return out.packets.join(sent, "handoff_id").select(F.col("handoff_id").alias("conv_id"), "packet_tokens", F.md5("history").alias("history"))


@query("""select conv_id, count(*)::bigint as n_messages from conversations where conv_id % 5 <> 0 group by conv_id having count(*) filter (role = 'assistant') > 0""")
def graph_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat graphs' states compiled; every fifth has a result without a call, which denies it. All messages are asked for."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("Decision: "), F.col("text"))).otherwise(F.concat(F.lit("Evidence: "), F.col("text")))
    kind = F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "system", "system").otherwise("human")
    rows = c.select(F.col("conv_id").alias("handoff_id"), F.col("turn").alias("pos"), F.to_json(F.struct(kind.alias("type"), text.alias("content"))).alias("item"))
    stray = c.where("conv_id % 5 = 0").select(F.col("conv_id").alias("handoff_id")).distinct().select("handoff_id", F.lit(99).cast("long").alias("pos"), F.lit('{"type":"tool","tool_call_id":"c","content":"x"}').alias("item"))
    heads = c.selectExpr("conv_id as handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json").distinct()
    out, _ = history.compile_graph(spark, heads, rows.unionByName(stray), Contract("Go on", ("decisions",), ("evidence",), 40_000))
    return out.packets.select(F.col("handoff_id").alias("conv_id"), F.col("n_items").cast("long").alias("n_messages"))


@query("""with t as (select conv_id, turn, text, role from conversations), f as (select conv_id, list(text order by turn) as messages, list(role order by turn) as roles, count(*) as n from t group by conv_id)
select conv_id, case when n > 6 then 'bad_budget' when conv_id % 3 = 0 then 'no_facts' when n > 1 and conv_id % 2 = 0 then 'absent_probe' end as code from f""")
def fixture_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as fixtures that test nothing in one way or another."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("messages"))
    none = F.array().cast("array<string>")
    rows = c.select("conv_id", "messages", F.when(F.size("messages") > 6, 0).otherwise(9).cast("long").alias("budget"), F.slice("messages", 1, 1).alias("secrets"), none.alias("clean"), F.when(F.col("conv_id") % 3 == 0, none).when((F.size("messages") > 1) & (F.col("conv_id") % 2 == 0), F.array(F.lit("nowhere at all"))).otherwise(F.slice("messages", -1, 1)).alias("facts"))
    return rows.select("conv_id", fixtures.broken_fixture().alias("code"))


@query("""with t as (select conv_id, turn, role, 'p' || (case when turn = 3 then 2 else turn end) as path, case when length(text) % 7 = 0 then '' else role end as category, 't' || (case when turn = 5 then 4 else turn end) as id from conversations)
select conv_id::varchar as version, t.id, category, t.path, case when count(*) over (partition by conv_id, t.id) > 1 then 'repeated_id' when count(*) over (partition by conv_id, t.path) > 1 then 'repeated_path' when category = '' then 'no_category' end as code from t""")
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as manifests."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "concat('t', case when turn = 5 then 4 else turn end) as id", "case when length(text) % 7 = 0 then '' else role end as category", "concat('p', case when turn = 3 then 2 else turn end) as path")
    return fixtures.manifest_tasks(c.groupBy(F.col("conv_id").cast("string").alias("version")).agg(F.collect_list(F.struct("id", "category", "path")).alias("tasks")))


@query("select conv_id, turn, ceil(strlen(text) / 4)::bigint as tokens from conversations")
def counter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default counter through the counter interface."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", counters.APPROX.column(F.col("text")).cast("long").alias("tokens"))


@query("""select conv_id, unnest(s.kept)::bigint as turn from (
 select conv_id, list_reduce(list_prepend({'turn': -1, 'bytes': 0, 'used': 2, 'n': 0, 'kept': []::int[]}, xs),
  lambda a, x: case when ceil((a.used + x.bytes + (a.n > 0)::int) / 4) <= 200 then {'turn': -1, 'bytes': 0, 'used': (a.used + x.bytes + (a.n > 0)::int)::int, 'n': a.n + 1, 'kept': list_append(a.kept, x.turn)} else a end) as s
 from (select conv_id, list({'turn': turn::int, 'bytes': strlen(text)::int, 'used': 0, 'n': 0, 'kept': []::int[]} order by turn) as xs from conversations group by conv_id))""")
def counted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit by whole texts, as counters that aren't additive need it; with the default counter SQL can follow."""
    c = table(spark, sf_dir, "conversations")
    items = c.select(F.col("conv_id").alias("handoff_id"), F.lit(0).alias("ord"), F.col("turn").alias("pos"), F.lit(False).alias("required"), F.col("text").alias("item"))
    heads = c.select(F.col("conv_id").alias("handoff_id")).distinct().select("handoff_id", F.lit("[").alias("before"), F.lit("]").alias("after"))
    out = counters.fit_counted(items, heads, counters.APPROX, 200)
    return out.where("kept").select(F.col("handoff_id").alias("conv_id"), F.col("pos").alias("turn"))
