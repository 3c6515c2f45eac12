"""The policy pipeline: global policies, then those of the matched rules, and one report per handoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.operators.frames import Frames, Policy, envelope_sizes
from relaypack.operators.routes import apply_routes
from relaypack.operators.shared import cut
from relaypack.sources.config import Config, ConfigurationError, check_order


#: Policies whose work is written down: patterns and summaries would else run again for each count of the policies after them.
COSTLY = ("redact", "egress_redact", "summarize")


def run_policies(f: Frames, chain: Sequence[Policy]) -> Frames:
    check_order(tuple(chain))
    for policy in chain:
        f = policy(f.next())
        if getattr(policy, "name", "") in COSTLY:
            f = f.with_(messages=cut(f.messages, "messages"), artifacts=cut(f.artifacts, "artifacts"), events=cut(f.events, "events"))
    return f


def _only(f: Frames, ids: DataFrame) -> Frames:
    semi = lambda d: d.join(ids, "handoff_id", "left_semi")
    return f.with_(handoffs=semi(f.handoffs), messages=semi(f.messages), artifacts=semi(f.artifacts), events=semi(f.events), denials=semi(f.denials))


def _union(parts: list[Frames]) -> Frames:
    out = parts[0]
    for p in parts[1:]:
        out = out.with_(**{n: getattr(out, n).unionByName(getattr(p, n)) for n in ("handoffs", "messages", "artifacts", "events", "denials")}, step=max(out.step, p.step))
    return out


def process(spark: SparkSession, f: Frames, config: Config) -> tuple[Frames, DataFrame]:
    """(frames, reports). Handoffs with the same rules take the same chain, so there is a branch for each combination of rules that
    the configuration allows to occur, not for each handoff."""
    original = f
    if not config.rules:
        done = run_policies(f, config.policies)
        return done, reports(original, done)
    f, told = apply_routes(f, spark, list(config.rules), on_multiple=config.on_multiple_match, on_unmatched=config.on_unmatched)
    told = told.where("code is null")
    key = F.array_join("rule_ids", "\0")
    by_id = {r.rule_id: r for r in config.rules}
    # distinct combinations of configured rules
    combos = [r[0] for r in told.select(key.alias("k")).distinct().collect()]
    parts = [_only(f, told.where(key == k).select("handoff_id")) for k in combos]
    out = []
    for k, part in zip(combos, parts, strict=True):
        chain = (*config.policies, *(p for i in k.split("\0") if i for p in by_id[i].policies))
        try:
            check_order(chain)
        except ConfigurationError:
            out.append(part.deny("route", "unsafe_policy_order", part.handoffs.select("handoff_id")))
            continue
        out.append(run_policies(part, chain))
    denied = _only(f, f.denials.select("handoff_id").distinct())
    done = _union([denied, *out])
    return done, reports(original, done)


#: Report columns and the actions that add to them.
TOTALS = {"redactions": ("redacted",), "duplicates_removed": ("duplicates_removed",), "protected_messages": ("protected",), "removed_messages": ("selected", "duplicates_removed", "summarized", "trimmed", "compiled")}


def reports(before: Frames, after: Frames) -> DataFrame:
    """One row per handoff: status, failure, tokens, savings and totals. It holds counts and codes only."""
    sent = envelope_sizes(after).select("handoff_id", F.col("tokens").alias("sent"))
    orig = envelope_sizes(before).select("handoff_id", F.col("tokens").alias("original_tokens"))
    total = after.events.groupBy("handoff_id").agg(
        *(F.sum(F.when(F.col("action").isin(*actions), F.col("count")).otherwise(0)).alias(c) for c, actions in TOTALS.items()),
        F.sum(F.coalesce(F.expr("try_cast(details['input_tokens'] as bigint)"), F.lit(0))).alias("summarizer_input_tokens"), F.sum(F.coalesce(F.expr("try_cast(details['output_tokens'] as bigint)"), F.lit(0))).alias("summarizer_output_tokens"),
        F.array_sort(F.collect_list(F.struct("step", "policy", "action", "count"))).alias("events"),
    )
    fail = after.denials.groupBy("handoff_id").agg(F.min_by("code", "step").alias("failure_code"), F.min_by("policy", "step").alias("failed_policy"))
    out = before.handoffs.select("handoff_id", "sender", "receiver").join(orig, "handoff_id").join(sent, "handoff_id", "left").join(total, "handoff_id", "left").join(fail, "handoff_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in (*TOTALS, "summarizer_input_tokens", "summarizer_output_tokens")}
    out = out.withColumns({**zero, "transmitted_tokens": F.when(F.col("failure_code").isNull(), F.coalesce("sent", F.lit(0))).otherwise(0).cast("long"), "status": F.when(F.col("failure_code").isNull(), "passed").otherwise("denied")}).drop("sent")
    saved = F.greatest(F.col("original_tokens") - F.col("transmitted_tokens"), F.lit(0))
    return out.withColumns({
        "saved_tokens": saved, "saved_percent": F.when(F.col("original_tokens") > 0, F.bround(saved * 100.0 / F.col("original_tokens"), 1)).otherwise(0.0),
        "net_saved_tokens": F.col("original_tokens") - F.col("transmitted_tokens") - F.col("summarizer_input_tokens") - F.col("summarizer_output_tokens"),
    })
