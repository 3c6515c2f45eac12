"""Evaluation records: status, invariants, joins with tasks and patches, summaries, regrading, resumed runs.

Observations are rows; a rule is a column. Nothing here calls a provider or runs a candidate's code: what these return is
a table that these operators read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions.arrow import arrow_function
from relaypack.operators.evaluation import strict_load

SUMMARY = "naive_summary"
#: The source actions' fields and operations.
ACTION_TEXTS, ACTION_NUMBERS = ("operation", "path", "query", "old", "new", "note"), ("start", "end")
OPERATIONS = ("list", "search", "read", "finish")
#: Category of a provider's error by its class; whether a call may be repeated (null: from HTTP status 500 on).
ERRORS: dict[str, tuple[str, bool | None]] = {
    "ProviderDependencyError": ("dependency_missing", False), "ProviderUsageUnavailableError": ("usage_missing", False), "ProviderProtocolError": ("protocol_error", False), "TimeoutError": ("case_timeout", True), "ModelTimeoutError": ("model_timeout", True),
    "APITimeoutError": ("provider_timeout", True), "RateLimitError": ("rate_limit", True), "APIStatusError": ("provider_http", None), "APIConnectionError": ("provider_connection", True), "ModelRefusalError": ("model_refusal", False),
    "ModelBehaviorError": ("invalid_output", False), "MaxTurnsExceeded": ("max_turns", False),
}


def status() -> Column:
    """Status of an observation from what happened: summary_failed, provider_failed, parsed, accepted (null: acceptance didn't run to its end)."""
    return F.when(F.col("summary_failed"), "summary_error").when(F.col("provider_failed"), "provider_error").when(~F.col("parsed"), "invalid_output").when(F.col("accepted").isNull(), "acceptance_error").otherwise("completed")


def whole_usage(prefix: str = "") -> tuple[Column, Column]:
    """(fully measured, entirely unknown) of the three token counts."""
    known = [F.col(f"{prefix}{c}").isNotNull() for c in ("input_tokens", "output_tokens", "total_tokens")]
    every = known[0] & known[1] & known[2]
    return every, ~(known[0] | known[1] | known[2])


def broken_rule() -> Column:
    """The first rule that a record breaks; null for a sound one."""
    measured, unknown = whole_usage()
    s, has = F.col("status"), lambda c: F.col(c).isNotNull()
    judged = s.isin("completed", "invalid_output")
    rules = [
        ("partial_usage", ~measured & ~unknown),
        ("retries_over_events", F.col("retry_count") > F.col("event_count")),
        ("preparation_of_other", (F.col("condition") != SUMMARY) & has("preparation_tokens")),
        ("preparation_missing", (F.col("condition") == SUMMARY) & (s != "summary_error") & ~has("preparation_tokens")),
        ("summary_error_of_other", (s == "summary_error") & (F.col("condition") != SUMMARY)),
        ("summary_error_claims", (s == "summary_error") & (has("receiver_input") | has("handoff_tokens") | has("grade"))),
        ("error_missing", s.isin("summary_error", "provider_error") & ~has("error")),
        ("input_missing", (s != "summary_error") & (~has("receiver_input") | ~has("handoff_tokens"))),
        ("evidence_missing", judged & (~has("raw_output") | ~has("grade") | ~measured | ~has("response_id"))),
        ("error_of_completed", (s == "completed") & has("error")),
        ("grade_of_error", (s == "provider_error") & has("grade")),
        ("success_of_failed", (s != "completed") & F.coalesce("grade", F.lit(False))),
    ]
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def provider_error() -> Column:
    """struct(category, status_code, retryable) of an error's class and HTTP status; nothing of its message."""
    kind, code = F.col("error_class"), F.col("status_code")
    category, again = F.lit("provider_error"), F.lit(False)
    for name, (told, retry) in ERRORS.items():
        category = F.when(kind == name, told).otherwise(category)
        again = F.when(kind == name, F.coalesce(code >= 500, F.lit(False)) if retry is None else F.lit(retry)).otherwise(again)
    return F.struct(category.alias("category"), F.when(kind == "APIStatusError", code).alias("status_code"), again.alias("retryable"))


# ---- joins


def tasks_of(records: DataFrame, tasks: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """task_id, n, ok: whether a task has each condition once and no other."""
    per = records.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("condition")).alias("has"))
    want = F.array(*map(F.lit, sorted(conditions)))
    out = tasks.select("task_id").join(per, "task_id", "left")
    return out.select("task_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce((F.col("n") == len(conditions)) & (F.col("has") == want), F.lit(False)).alias("ok"))


CONTROLS = {"gold_control": True, "unchanged_control": False}


def outcomes(tasks: DataFrame, predictions: DataFrame, graded: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """task_id, condition, status, resolved of every task under every condition.

    ``predictions``: task_id, condition, patch; ``graded``: task_id, condition, resolved. Controls need no patch: one takes the
    task's own, one none.
    """
    grid = tasks.select("task_id", F.explode(F.array(*(F.lit(c) for c in (*conditions, *CONTROLS)))).alias("condition"))
    control = F.col("condition").isin(*CONTROLS)
    told = grid.join(predictions.select("task_id", "condition", "patch"), ["task_id", "condition"], "left").join(graded.select("task_id", "condition", "resolved"), ["task_id", "condition"], "left")
    none = ~control & (F.coalesce("patch", F.lit("")) == "")
    state = F.when(none, "no_candidate_patch").when(F.col("resolved").isNull(), "upstream_evaluation_error").otherwise("graded")
    return told.select("task_id", "condition", state.alias("status"), F.when(none, False).otherwise(F.col("resolved")).alias("resolved"))


def controls_valid(told: DataFrame) -> DataFrame:
    """task_id, valid: the task's own patch resolves it and no patch doesn't."""
    right = F.lit(True)
    for name, want in CONTROLS.items():
        right = right & (F.count_if((F.col("condition") == name) & F.col("resolved").eqNullSafe(F.lit(want))) == 1)
    return told.groupBy("task_id").agg(right.alias("valid"))


# ---- summaries


def distribution(rows: DataFrame, fields: Sequence[str] = ("repo", "difficulty"), by: str = "split") -> DataFrame:
    """split, field, value, n: how each split is spread over each field."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")
    return rows.select(by, each).groupBy(by, "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def condition_summary(rows: DataFrame) -> DataFrame:
    """Per condition: outcomes, and means over the rows that have a context only. A run that failed before grading has its calls as preparation."""
    early = F.col("status") == "failed_before_grading"
    prepared = lambda c, whole: F.sum(F.coalesce(c, F.when(early, F.col(whole)), F.lit(0))).cast("long")
    return rows.groupBy("condition").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.coalesce("resolved", F.lit(False))).alias("resolved"), F.count_if(F.col("resolved").isNull()).alias("upstream_errors"),
        F.count_if(F.col("status") == "candidate_generated").alias("candidate_patches"), F.count_if(early).alias("failed_before_grading"), F.count("handoff_tokens").alias("packets_measured"),
        F.round(F.avg("handoff_tokens"), 1).alias("mean_handoff_tokens"), F.sum("model_calls").cast("long").alias("model_calls"), prepared("preparation_calls", "model_calls").alias("preparation_calls"),
        F.sum(F.coalesce("tool_steps", F.lit(0))).cast("long").alias("tool_actions"), F.count_if(F.col("tool_steps") >= F.col("budget")).alias("continuations_at_budget"),
    )


def add_usage(*names: str) -> Column:
    """Sum of counts, null as zero."""
    out = F.lit(0).cast("long")
    for n in names:
        out = out + F.coalesce(F.col(n), F.lit(0))
    return out


# ---- runs


def same_configuration(stored: DataFrame, wanted: DataFrame, fields: Sequence[str], key: str = "run_id") -> DataFrame:
    """key, same: whether a stored run's configuration is the wanted one in all fields (null equals null)."""
    b = wanted.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in fields))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stored.join(b, key).select(key, same.alias("same"))


def still_to_run(plan: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a plan without a stored record: an append of their results can be repeated and adds nothing twice."""
    return plan.join(stored.select(*keys).distinct(), [*keys], "left_anti")


def regrade(old: DataFrame, new: DataFrame, keys: Sequence[str], graded: Sequence[str], *, revision: str) -> DataFrame:
    """Old records with their new grades; where these differ, ``original_grading`` (JSON) keeps the old ones and ``revision`` names the new.

    Records without a new grade stay as they are.
    """
    n = new.select(*keys, F.lit(True).alias("_has"), *(F.col(c).alias(f"_{c}") for c in graded))
    both = old.join(n, [*keys], "left")
    differ = F.lit(False)
    for c in graded:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    differ = F.coalesce(F.col("_has"), F.lit(False)) & differ
    kept = [c for c in old.columns if c not in graded]
    before = F.to_json(F.struct(*(F.col(c) for c in graded)), {"ignoreNullFields": "false"})
    return both.select(*kept, *(F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in graded), F.when(differ, before).alias("original_grading"), F.when(differ, revision).alias("grading_revision"))


def run_stream(records: DataFrame, *, key: str = "task_id", place: str = "idx") -> DataFrame:
    """key, line_no, kind, n, record: each run's lines, a header, its observations in order, a footer with their number."""
    of = [c for c in records.columns if c != key]
    w = Window.partitionBy(key).orderBy(place)
    lines = records.select(key, F.row_number().over(w).alias("line_no"), F.lit("observation").alias("kind"), F.lit(None).cast("long").alias("n"), F.to_json(F.struct(*of)).alias("record"))
    ends = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string").alias("record")
    head = ends.select(key, F.lit(0).alias("line_no"), F.lit("run_started").alias("kind"), F.lit(None).cast("long").alias("n"), none)
    foot = ends.select(key, (F.col("n") + 1).cast("int").alias("line_no"), F.lit("run_completed").alias("kind"), "n", none)
    return lines.unionByName(head).unionByName(foot)


def whole_runs(stream: DataFrame, key: str = "task_id") -> DataFrame:
    """key, whole: whether a run has one header first and one footer last that tells the number of its observations."""
    last = F.max("line_no")
    seen = F.count_if(F.col("kind") == "observation")
    one = lambda kind, at: F.count_if((F.col("kind") == kind) & (F.col("line_no") == at)) == 1
    bound = stream.withColumn("_last", F.max("line_no").over(Window.partitionBy(key)))
    whole = one("run_started", 0) & one("run_completed", F.col("_last")) & (F.max(F.when(F.col("kind") == "run_completed", F.col("n"))) == seen) & (F.count(F.lit(1)) == seen + 2) & (last == seen + 1)
    return bound.groupBy(key).agg(F.coalesce(whole, F.lit(False)).alias("whole"))


def write_runs(records: DataFrame, path: str, *, key: str = "task_id", place: str = "idx") -> None:
    """JSON lines, a folder per run, a run's lines in order in one file."""
    stream = run_stream(records, key=key, place=place)
    stream.repartition(key).sortWithinPartitions(key, "line_no").write.mode("append").partitionBy(key).json(path)


# ---- candidates' output


@arrow_function("string")
def parse_actions(texts: pd.Series, writable: pd.Series) -> pd.Series:
    """The actions of a text of JSON objects, one after the other, as a JSON array; null if one of them breaks the grammar."""
    fields = {*ACTION_TEXTS, *ACTION_NUMBERS}

    def sound(x, may_edit) -> bool:
        if not isinstance(x, dict) or x.keys() != fields:
            return False
        typed = all(type(x[c]) is str for c in ACTION_TEXTS) and all(type(x[c]) is int for c in ACTION_NUMBERS)
        return typed and (x["operation"] in OPERATIONS or may_edit and x["operation"] == "edit")

    def one(text, may_edit):
        out, at, decode = [], 0, json.JSONDecoder().raw_decode
        text = (text or "").strip()
        while at < len(text):
            try:
                value, at = decode(text, at)
            except ValueError:
                return None
            if not sound(value, may_edit):
                return None
            out.append(value)
            at += len(text) - at - len(text[at:].lstrip())
        return json.dumps(out, ensure_ascii=False, separators=(",", ":")) if out else None

    return pd.Series([one(*x) for x in zip(texts, writable, strict=True)])


def exact_object(text: Column, keys: Sequence[str], most_bytes: int) -> Column:
    """Null for an object of exactly these keys within the size, else the rule broken: too_large, not_an_object or wrong_keys."""
    have = F.json_object_keys(text)
    return F.when(F.octet_length(text) > most_bytes, "too_large").when(have.isNull(), "not_an_object").when(F.array_sort(have) != F.array(*map(F.lit, sorted(keys))), "wrong_keys")


@arrow_function("boolean")
def strict_json(texts: pd.Series) -> pd.Series:
    """Whether a text is JSON without repeated keys, NaN or infinities."""

    def one(text) -> bool:
        try:
            strict_load(text)
        except (ValueError, TypeError):
            return False
        return True

    return texts.map(one)


def single_edit(text: Column, old: Column) -> Column:
    """Whether an edit's old text occurs exactly once (without overlap) in a file's text."""
    return (F.length(old) > 0) & (F.length(text) - F.length(F.replace(text, old, F.lit(""))) == F.length(old))


def broken_request() -> Column:
    """The first rule that a run's request breaks: 1 to 10 tasks, 1 to 3 candidates, distinct conditions, paths that stay inside."""
    outside = lambda p: p.startswith("/") | p.contains("\\") | p.rlike(r"(^|/)\.\.(/|$)") | (p == "")
    rules = [
        ("task_count", ~F.size("tasks").between(1, 10)), ("candidate_count", ~F.col("candidates").between(1, 3)),
        ("repeated_condition", F.size("conditions") != F.size(F.array_distinct("conditions"))), ("path_outside", F.exists("paths", outside)),
    ]
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out
