"""Route rules: which policies a handoff's sender and receiver call for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaypack.functions.text import glob_regex
from relaypack.operators.frames import Frames, Policy

RULES = "rule_ord int, rule_id string, sender_pattern string, receiver_pattern string"


@dataclass(frozen=True)
class Rule:
    sender: str
    receiver: str
    policies: tuple[Policy, ...] = field(default=(), compare=False)
    rule_id: str = ""


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.rule_id or f"rule-{i}", glob_regex(r.sender), glob_regex(r.receiver)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def match(handoffs: DataFrame, rules: DataFrame) -> DataFrame:
    """handoff_id, rule_ord, rule_id, n_rules for each rule that a handoff matches.

    Rules meet the distinct routes, not the handoffs: a busy route is matched once and its handoffs are joined by key.
    """
    routes = handoffs.select("sender", "receiver").distinct()
    hit = F.expr("sender rlike sender_pattern and receiver rlike receiver_pattern")
    # the rules come from one configuration file
    found = routes.join(F.broadcast(rules), hit).groupBy("sender", "receiver").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "rule_id"))).alias("rules"))
    joined = handoffs.join(found, ["sender", "receiver"])
    return joined.select("handoff_id", F.size("rules").alias("n_rules"), F.explode("rules").alias("r")).select("handoff_id", "r.rule_ord", "r.rule_id", "n_rules")


def resolve(handoffs: DataFrame, rules: DataFrame, *, on_multiple: str = "error", on_unmatched: str = "error") -> DataFrame:
    """handoff_id, rule_ids (array, in rule order), code (null, ``ambiguous_route`` or ``unmatched_route``), warned."""
    if on_multiple not in ("error", "first", "all") or on_unmatched not in ("error", "warn", "pass"):
        raise ValueError("bad route behaviour")
    by = match(handoffs, rules).groupBy("handoff_id").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "rule_id"))).alias("r"))
    out = handoffs.select("handoff_id").join(by, "handoff_id", "left")
    ids = F.transform(F.coalesce("r", F.array().cast("array<struct<rule_ord:int,rule_id:string>>")), lambda x: x["rule_id"])
    n = F.size(ids)
    code = F.when((n > 1) & F.lit(on_multiple == "error"), "ambiguous_route").when((n == 0) & F.lit(on_unmatched == "error"), "unmatched_route")
    chosen = F.slice(ids, 1, 1) if on_multiple == "first" else ids
    return out.select("handoff_id", chosen.alias("rule_ids"), code.alias("code"), ((n == 0) & F.lit(on_unmatched == "warn")).alias("warned"))


def apply_routes(f: Frames, spark: SparkSession, rules: list[Rule], *, on_multiple: str = "error", on_unmatched: str = "error") -> tuple[Frames, DataFrame]:
    """Frames with the unroutable denied, and resolve()'s table."""
    told = resolve(f.handoffs, rules_table(spark, rules), on_multiple=on_multiple, on_unmatched=on_unmatched)
    f = f.event("route", "rules_matched", told.where("size(rule_ids) > 0 and code is null").select("handoff_id", F.size("rule_ids").alias("count"), F.create_map(F.lit("rule_ids"), F.array_join("rule_ids", ",")).alias("details")))
    f = f.event("route", "route_unmatched", told.where("size(rule_ids) = 0").select("handoff_id", F.lit(0).alias("count")))
    f = f.event("route", "route_ambiguous", told.where("code = 'ambiguous_route'").select("handoff_id", F.size("rule_ids").alias("count")))
    for code in ("ambiguous_route", "unmatched_route"):
        f = f.deny("route", code, told.where(F.col("code") == code))
    return f, told


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
