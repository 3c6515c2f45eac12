"""The audit trail: versions of events, emission once, keyed fingerprints, diagnostics, what must be true of a report."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaypack.operators.compiler import Contract
from relaypack.operators.frames import Frames, Policy

#: What opens a section in a text, for the hints.
HEADINGS = {"constraints": "Constraint:", "decisions": "Decision:", "evidence": "Evidence:", "completed_work": "Completed:", "failed_attempts": "Failed attempt:", "pending_work": "TODO:", "tool_results": "Tool result:"}


# ---- versions and fingerprints


def described(value: Any) -> Any:
    """A setting as JSON: sets and mappings sorted, patterns by their text, anything else by its type only."""
    kind = f"{type(value).__module__}.{type(value).__qualname__}"
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, dict):
        return sorted(([described(k), described(v)] for k, v in value.items()), key=lambda x: json.dumps(x[0], sort_keys=True))
    if isinstance(value, (list, tuple)):
        return [described(x) for x in value]
    if isinstance(value, (set, frozenset)):
        return sorted(map(described, value), key=lambda x: json.dumps(x, sort_keys=True))
    if isinstance(getattr(value, "pattern", None), str):
        return {"pattern": value.pattern, "type": kind}
    if callable(value) and hasattr(value, "__qualname__"):
        return f"{value.__module__}.{value.__qualname__}"
    return {"type": kind}


def policy_material(policy: Policy) -> dict[str, Any]:
    """Name, version and settings of a policy: what its ``fingerprint_material`` tells, else what it was made with."""
    hook = getattr(policy, "fingerprint_material", None)
    if callable(hook):
        settings = described(hook())
    else:
        code, cells = getattr(policy, "__code__", None), getattr(policy, "__closure__", None) or ()
        held = dict(zip(code.co_freevars, (c.cell_contents for c in cells), strict=True)) if code else {}
        settings = described({k: v for k, v in held.items() if not isinstance(v, Column)})
    return {"name": getattr(policy, "name", type(policy).__name__), "version": str(getattr(policy, "version", "1")), "settings": settings}


def fingerprint(policies: Sequence[Policy], rules: Sequence[Any] = (), *, counter: str = "approx", on_unmatched: str = "error", on_multiple: str = "error") -> str:
    """SHA-256 over policies in order, rules, the token counter and the behaviour of routes."""
    told = {
        "policies": [policy_material(p) for p in policies], "rules": [[r.rule_id, r.sender, r.receiver, [policy_material(p) for p in r.policies]] for r in rules],
        "counter": counter, "on_unmatched": on_unmatched, "on_multiple": on_multiple,
    }
    return hashlib.sha256(json.dumps(told, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def stamped(events: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Events with ``policy_version``: that of the policy of their step (steps count from 1); the engine's own events have version 1."""
    versions = [str(getattr(p, "version", "1")) for p in policies]
    return events.withColumn("policy_version", F.coalesce(F.try_element_at(F.array(*map(F.lit, versions)).cast("array<string>"), F.greatest(F.col("step"), F.lit(1))), F.lit("1")))


def keyed(digest: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a text under a key, as lower-case hex, by two plain digests."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in block).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(digest, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


# ---- emission


def emission(spark: SparkSession, reports: DataFrame, written: DataFrame | None, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports to write now, final reports).

    ``written``: handoff_id of reports that an earlier, broken run has written: they aren't written again. ``failed``: handoff_id,
    reporter of reporters that failed. A failure denies a handoff that had passed, and only warns at one denied already; every failure
    leaves an event and a warning.
    """
    told = failed.groupBy("handoff_id").agg(F.array_sort(F.collect_set("reporter")).alias("reporters"))
    warn = F.transform(F.coalesce("reporters", F.array().cast("array<string>")), lambda r: F.concat(F.lit("reporter failed: "), r))
    hit = F.col("reporters").isNotNull() & (F.col("status") == "passed")
    final = reports.join(told, "handoff_id", "left").withColumns({
        "warnings": warn, "failure_code": F.when(hit, "audit_export").otherwise(F.col("failure_code")), "failed_policy": F.when(hit, "audit").otherwise(F.col("failed_policy")),
        "transmitted_tokens": F.when(hit, 0).otherwise(F.col("transmitted_tokens")).cast("long"), "status": F.when(hit, "denied").otherwise(F.col("status")),
    }).drop("reporters")
    due = reports if written is None else reports.join(written.select("handoff_id").distinct(), "handoff_id", "left_anti")
    return due, final


def emit(spark: SparkSession, reports: DataFrame, path: str, reporters: dict[str, Callable[[dict], None]]) -> DataFrame:
    """Write each report once and call the reporters; the final reports.

    Files of a job appear together when it ends, and reports that are there are left out, so a repeated run adds none. Reporters run
    where the rows are; one that raises is recorded by name, never by its message.
    """
    try:
        written = spark.read.json(path).select("handoff_id")
    except Exception as x:  # no such path yet
        if "PATH_NOT_FOUND" not in str(x):
            raise
        written = None
    due, _ = emission(spark, reports, written, spark.createDataFrame([], "handoff_id bigint, reporter string"))

    def call(batches):
        import pyarrow as pa

        for batch in batches:
            ids, names = [], []
            for row in batch.to_pylist():
                for name, report in reporters.items():
                    try:
                        report(row)
                    except Exception:
                        ids.append(row["handoff_id"])
                        names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], ["handoff_id", "reporter"])

    from relaypack.operators.shared import cut

    failed = cut(due.mapInArrow(call, "handoff_id bigint, reporter string"), "failed")
    _, final = emission(spark, reports, None, failed)
    out = final if written is None else final.join(written.distinct(), "handoff_id", "left_anti")
    out.write.mode("append").json(path)
    return final


# ---- diagnostics


def hints(contract: Contract, before: DataFrame, after: DataFrame) -> DataFrame:
    """handoff_id, stage, missing, hints of handoffs that lack a required section after the policies.

    ``before``, ``after``: handoff_id, section, n. A section that was there before was removed by a policy; the others were never given.
    """
    need = F.array(*map(F.lit, contract.required)).cast("array<string>")
    of = lambda d, name: d.where("n > 0").groupBy("handoff_id").agg(F.collect_set("section").alias(name))
    ids = before.select("handoff_id").unionAll(after.select("handoff_id")).distinct()
    none = F.array().cast("array<string>")
    told = ids.join(of(before, "had"), "handoff_id", "left").join(of(after, "has"), "handoff_id", "left").withColumns({"had": F.coalesce("had", none), "has": F.coalesce("has", none)})
    told = told.withColumn("missing", F.array_except(need, F.col("has"))).where("size(missing) > 0")
    given = F.size(F.array_except("missing", "had")) == 0
    names = F.create_map(*(F.lit(x) for p in HEADINGS.items() for x in p))
    way = lambda s: F.when(given, F.lit("a policy removed it")).when(s == "artifacts", F.lit("add an artifact")).otherwise(F.concat(F.lit("send a message of kind "), s, F.lit(" or begin a text with "), F.try_element_at(names, s)))
    return told.select("handoff_id", F.when(given, "pipeline_output").otherwise("sender_state").alias("stage"), "missing", F.transform("missing", lambda s: F.concat(s, F.lit(": "), way(s))).alias("hints"))


def diagnostics_text() -> Column:
    """Readable lines of a row of stage, section_counts, unclassified_indices (null: not told) and hints."""
    counts = F.filter(F.array_sort(F.map_entries("section_counts")), lambda e: e["value"] > 0)
    listed = F.array_join(F.transform(counts, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    some = lambda c: F.when(c == "", "none").otherwise(c)
    at = F.when(F.col("unclassified_indices").isNotNull(), F.concat(F.lit("unclassified messages (from 0): "), some(F.array_join(F.col("unclassified_indices").cast("array<string>"), ", "))))
    return F.concat_ws("\n", F.concat(F.lit("sections ("), F.col("stage"), F.lit("): "), some(F.coalesce(listed, F.lit("")))), at, F.array_join("hints", "\n"))


# ---- what must be true of reports


def report_checks() -> dict[str, Column]:
    """Named conditions on a report row: numbers that agree, nothing sent after a denial."""
    c = F.col
    return {
        "known_status": c("status").isin("passed", "denied"), "code_when_denied": (c("status") == "denied") == c("failure_code").isNotNull(), "policy_when_denied": c("failure_code").isNull() == c("failed_policy").isNull(),
        "nothing_sent_when_denied": (c("status") != "denied") | (c("transmitted_tokens") == 0), "original_positive": c("original_tokens") > 0, "sent_not_negative": c("transmitted_tokens") >= 0,
        "saved_agrees": c("saved_tokens") == F.greatest(c("original_tokens") - c("transmitted_tokens"), F.lit(0)), "percent_in_range": c("saved_percent").between(0, 100),
        "net_agrees": c("net_saved_tokens") == c("original_tokens") - c("transmitted_tokens") - c("summarizer_input_tokens") - c("summarizer_output_tokens"), "counts_not_negative": F.least("redactions", "duplicates_removed", "protected_messages", "removed_messages") >= 0,
        "duplicates_among_removed": c("duplicates_removed") <= c("removed_messages"),
    }


def failed_checks(reports: DataFrame) -> DataFrame:
    """handoff_id, failed: names of the conditions that a report breaks (null counts as broken)."""
    checks = report_checks()
    names = F.array_compact(F.array(*(F.when(~F.coalesce(x, F.lit(False)), n) for n, x in checks.items())))
    return reports.select("handoff_id", names.alias("failed"))


def recall(found: DataFrame, planted: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: n, recall over planted (id), false positives among clean (id), of what was found (id)."""
    hit = found.select("id").distinct().withColumn("hit", F.lit(1))
    rate = lambda d, n, h: d.select("id").distinct().join(hit, "id", "left").agg(F.count(F.lit(1)).alias(n), F.count("hit").alias(h))
    return rate(planted, "n", "hits").crossJoin(rate(clean, "n_clean", "false_positives")).withColumn("recall", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))


def repeatable(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """key, same: whether two runs say the same of each key."""
    return first.select(key, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key, "full").select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def readme_table(rows: DataFrame, columns: Sequence[tuple[str, str]], order: str) -> DataFrame:
    """One row, ``table``: a Markdown table of a few rows (a benchmark's), in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for _, c in columns)), F.lit(" |"))
    head = "| " + " | ".join(n for n, _ in columns) + " |\n|" + "-|" * len(columns)
    body = rows.select(F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return body.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("xs", lambda x: x["l"]), "\n")).alias("table"))


def last_events(events: DataFrame, n: int = 1) -> DataFrame:
    """The last n steps' events of each handoff."""
    w = Window.partitionBy("handoff_id").orderBy(F.col("step").desc())
    return events.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


def run_id(f: Frames) -> Frames:
    """Handoffs with a random ``run_id`` and the time of the run; written by the caller before it is read twice."""
    return f.with_(handoffs=f.handoffs.withColumns({"run_id": F.uuid(), "started_at": F.current_timestamp()}))
