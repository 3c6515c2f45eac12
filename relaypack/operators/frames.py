"""Handoffs as four tables keyed by ``handoff_id``; a policy maps these to these.

A rule that fails denies its handoff: it is recorded with a code and its rows leave, while the others go on. Nothing is
raised inside a job. All tables are dealt by ``handoff_id``, so the windows and joins of a chain of policies share one
exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack import schema
from relaypack.functions import tokens as tk
from relaypack.operators.shared import cut

EVENT = "handoff_id bigint, step int, policy string, action string, count bigint, details map<string,string>"
DENIAL = "handoff_id bigint, step int, code string, policy string"


@dataclass(frozen=True)
class Frames:
    handoffs: DataFrame
    messages: DataFrame
    artifacts: DataFrame
    events: DataFrame
    denials: DataFrame
    #: Whether contents or metadata hold JSON; if not, no Python is needed.
    nested: bool = False
    step: int = 0

    def with_(self, **changes) -> Frames:
        return replace(self, **changes)

    def event(self, policy: str, action: str, counts: DataFrame) -> Frames:
        """Record (handoff_id, count) with optional details."""
        details = F.col("details") if "details" in counts.columns else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        rows = counts.select("handoff_id", F.lit(self.step).alias("step"), F.lit(policy).alias("policy"), F.lit(action).alias("action"), F.col("count").cast("long").alias("count"), details.alias("details"))
        return self.with_(events=self.events.unionByName(rows))

    def deny(self, policy: str, code: str, ids: DataFrame, *, written: bool = False) -> Frames:
        """Deny the handoffs in ``ids`` (handoff_id): their rows leave.

        The ids are written first, so that a chain of policies stays a chain and doesn't compute what is before it twice at
        each link; mostly there are none, and then nothing is joined at all. ``written``: the ids come from a written table.
        """
        rows = ids.select("handoff_id").distinct()
        rows = rows if written else cut(rows, "denied")
        if rows.isEmpty():
            return self
        gone = rows.select("handoff_id", F.lit(self.step).alias("step"), F.lit(code).alias("code"), F.lit(policy).alias("policy"))
        return self.with_(
            denials=self.denials.unionByName(gone),
            messages=self.messages.join(rows, "handoff_id", "left_anti"),
            artifacts=self.artifacts.join(rows, "handoff_id", "left_anti"),
        )

    def live(self) -> DataFrame:
        return self.handoffs.join(self.denials.select("handoff_id"), "handoff_id", "left_anti")

    def next(self) -> Frames:
        return self.with_(step=self.step + 1)


Policy = Callable[[Frames], Frames]


def frames(spark: SparkSession, handoffs: DataFrame, messages: DataFrame, artifacts: DataFrame | None = None, *, nested: bool = False) -> Frames:
    """Public rows only: engine columns of the input are dropped and set anew."""
    m = messages.drop(*schema.ENGINE_COLUMNS).withColumns({"protected": F.lit(False), "section": F.lit(None).cast("string"), "src_key": F.lit(None).cast("string")})
    a = artifacts if artifacts is not None else spark.createDataFrame([], schema.ARTIFACTS)
    a = a.drop("protected").withColumn("protected", F.lit(False))
    return Frames(handoffs, m, a, spark.createDataFrame([], EVENT), spark.createDataFrame([], DENIAL), nested)


def text_messages(rows: DataFrame, handoff: Column, place: Column, role: Column, text: Column, **more: Column) -> DataFrame:
    """Message rows of plain texts."""
    return rows.select(
        handoff.cast("long").alias("handoff_id"), place.cast("int").alias("msg_idx"), role.alias("role"), F.lit("text").alias("content_type"), text.alias("content"),
        more.get("kind", F.lit("message")).alias("kind"), more.get("tags", F.array().cast("array<string>")).alias("tags"), more.get("metadata_json", F.lit("{}")).alias("metadata_json"),
    )


def envelope_sizes(f: Frames) -> DataFrame:
    """handoff_id, n_messages, n_artifacts, bytes, tokens of every live handoff, in the wide form."""
    m = f.messages.groupBy("handoff_id").agg(F.sum(tk.message_bytes(wide=True)).alias("mb"), F.count(F.lit(1)).alias("n_messages"))
    a = f.artifacts.groupBy("handoff_id").agg(F.sum(tk.artifact_bytes(wide=True)).alias("ab"), F.count(F.lit(1)).alias("n_artifacts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    size = tk.envelope_base(F.col("sender"), F.col("receiver"), F.col("metadata_json")) + zero("mb") + zero("ab") + 2 * (tk.separators(zero("n_messages")) + tk.separators(zero("n_artifacts")))
    out = f.live().join(m, "handoff_id", "left").join(a, "handoff_id", "left")
    return out.select("handoff_id", zero("n_messages").alias("n_messages"), zero("n_artifacts").alias("n_artifacts"), size.alias("bytes"), tk.message_tokens(size).alias("tokens"))
