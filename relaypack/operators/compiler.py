"""The contract compiler: required sections whole, preferred ones greedily, twice, within a packet's byte budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaypack.functions import tokens as tk
from relaypack.operators import packets
from relaypack.operators.fit import fit_stream
from relaypack.operators.frames import Frames, Policy, envelope_sizes
from relaypack.operators.normalize import normalize_frames
from relaypack.operators.shared import cut
from relaypack.operators.state import explicit_sections
from relaypack.schema import SECTIONS


@dataclass(frozen=True)
class Contract:
    """What a receiver needs: sections it must and may get, in order, and how many tokens."""

    goal: str
    required: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    max_tokens: int = 1000
    needs: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        every = (*self.required, *self.preferred)
        needs = [n.strip() for n in self.needs]
        if not self.goal.strip() or self.max_tokens <= 0 or not all(needs) or len(set(needs)) < len(needs):
            raise ValueError("a contract has a goal, a positive budget and distinct needs")
        if len(set(every)) < len(every) or not set(every) <= set(SECTIONS) or not every:
            raise ValueError("sections of a contract are known, distinct and at least one")

    def ord(self, section: Column) -> Column:
        return (F.array_position(F.array(*map(F.lit, (*self.required, *self.preferred))), section) - 1).cast("int")

    @property
    def max_bytes(self) -> int:
        return 4 * self.max_tokens


def items_of(f: Frames, contract: Contract) -> DataFrame:
    """handoff_id, section, ord (contract order), pos, bytes, item, required, src (m or a), idx for each requested item."""
    m = f.messages.where(F.col("section").isNotNull()).select("handoff_id", "section", F.lit("m").alias("src"), F.col("msg_idx").alias("idx"), tk.message_bytes(wide=False).alias("bytes"), packets.message_item().alias("item"))
    a = f.artifacts.select("handoff_id", F.lit("artifacts").alias("section"), F.lit("a").alias("src"), F.col("art_idx").alias("idx"), tk.artifact_bytes(wide=False).alias("bytes"), packets.artifact_item().alias("item"))
    every = m.unionByName(a).withColumn("ord", contract.ord(F.col("section"))).where("ord >= 0")
    return every.withColumns({"pos": F.col("ord").cast("long") * F.lit(_PLACE) + F.col("idx"), "required": F.col("ord") < len(contract.required)})


def classify(messages: DataFrame) -> DataFrame:
    """Section by kind or tag, where it isn't set."""
    found = explicit_sections()
    return messages.withColumn("section", F.coalesce("section", F.when(F.size(found) == 1, F.get(found, 0))))


def section_counts(f: Frames) -> DataFrame:
    m = f.messages.where("section is not null").select("handoff_id", "section")
    return m.unionAll(f.artifacts.select("handoff_id", F.lit("artifacts").alias("section"))).groupBy("handoff_id", "section").agg(F.count(F.lit(1)).alias("n"))


def missing_required(f: Frames, contract: Contract) -> DataFrame:
    """handoff_id, missing (sections in contract order), hints, section_counts of handoffs that lack a required section."""
    have = section_counts(f).groupBy("handoff_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("section_counts"))
    need = F.array(*map(F.lit, contract.required)).cast("array<string>")
    keys = F.coalesce(F.map_keys("section_counts"), F.array().cast("array<string>"))
    out = f.live().select("handoff_id").join(have, "handoff_id", "left").withColumn("missing", F.array_except(need, keys)).where("size(missing) > 0")
    hint = lambda s: F.when(s == "artifacts", F.lit("add an artifact")).otherwise(F.concat(F.lit("label a message as "), s))
    return out.withColumn("hints", F.transform("missing", hint))


_PLACE = 1 << 40


def verdict(f: Frames, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(verdicts, kept).

    Verdicts, a row a handoff: code (null if it compiles; rows of two sections don't), missing, used (bytes of base and required items), total,
    omitted (by preferred section), omitted_count. ``kept``: handoff_id, pos of the preferred items that fit.

    Everything is grouped sums over narrow rows and one pass over the preferred items in order, with a constant state: no handoff's items
    are held together.
    """
    items = items_of(f, contract).select("handoff_id", "section", "ord", "pos", "bytes", "required")
    by = items.groupBy("handoff_id").agg(F.sum(F.when(F.col("required"), F.col("bytes"))).alias("need"), F.count_if("required").alias("n_need"), F.collect_set("section").alias("has"))  # no more than there are sections
    base = f.live().select("handoff_id", tk.packet_base(F.col("sender"), F.col("receiver"), F.lit(contract.goal.strip())).cast("bigint").alias("base"))
    double = f.messages.where(F.size(explicit_sections()) > 1).select("handoff_id", F.lit(True).alias("double")).distinct()
    v = base.join(by, "handoff_id", "left").join(double, "handoff_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    need = F.array(*map(F.lit, contract.required)).cast("array<string>")
    n_sections = F.size(F.array_intersect("has", need))
    v = v.withColumns({"missing": F.array_except(need, F.col("has")), "used": (F.col("base") + F.coalesce("need", F.lit(0)) + F.coalesce("n_need", F.lit(0)) - n_sections).cast("bigint")})
    v = v.withColumn("code", F.when(F.coalesce("double", F.lit(False)) | (F.size("missing") > 0), "contract").when(F.col("used") > contract.max_bytes, "budget_exceeded"))
    v = cut(v.select("handoff_id", "code", "missing", "used"), "needs")
    if not contract.preferred:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
        zero = F.lit(0).cast("bigint")
        return v.withColumns({"total": F.col("used"), "omitted": none, "omitted_count": zero}), v.where("false").select("handoff_id", zero.alias("pos"))
    tried = cut(fit_stream(items.where("not required"), v.where("code is null").select("handoff_id", "used", F.lit(contract.max_bytes).alias("max_bytes"))), "tried")
    took = F.col("kept")
    counts = [(s, F.count_if(F.col("ord") == i), F.count_if((F.col("ord") == i) & took)) for i, s in enumerate(contract.preferred, len(contract.required))]
    sums = tried.groupBy("handoff_id").agg(
        F.sum(F.when(took, F.col("bytes")).otherwise(0)).alias("more"), F.count_if(took).alias("n"), F.count_distinct(F.when(took, F.col("ord"))).alias("n_ords"),
        F.filter(F.array(*(F.struct(F.lit(s).alias("section"), (there - taken).alias("n"), there.alias("there")) for s, there, taken in counts)), lambda x: x["there"] > 0).alias("told"),
    )
    nothing = F.array().cast("array<struct<section:string,n:bigint,there:bigint>>")
    v = v.join(sums, "handoff_id", "left").withColumn("told", F.coalesce("told", nothing))
    total = F.col("used") + F.coalesce(F.col("more") + F.col("n") - F.col("n_ords"), F.lit(0))
    v = v.select("handoff_id", "code", "missing", "used", total.cast("bigint").alias("total"), F.map_from_entries(F.transform("told", lambda x: F.struct(x["section"], x["n"]))).alias("omitted"), F.aggregate("told", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("omitted_count"))
    return v, tried.where("kept").select("handoff_id", "pos")


@dataclass(frozen=True)
class Compilation:
    packets: DataFrame
    items: DataFrame
    budget: DataFrame
    frames: Frames


def _kept(items: DataFrame, v: DataFrame, some: DataFrame) -> DataFrame:
    """Items that a verdict keeps."""
    must = items.where("required").join(v.where("code is null").select("handoff_id"), "handoff_id", "left_semi")
    return must.unionByName(items.where("not required").join(some, ["handoff_id", "pos"], "left_semi"))


def _keep(f: Frames, contract: Contract, v: DataFrame, kept: DataFrame) -> Frames:
    """Rows of the frames that a verdict keeps; handoffs with a code are denied."""
    some = kept.withColumnRenamed("pos", "_pos")

    def of(rows: DataFrame, section: Column, idx: str) -> DataFrame:
        rows = rows.withColumn("_ord", contract.ord(section)).withColumn("_pos", F.col("_ord").cast("long") * F.lit(_PLACE) + F.col(idx))
        must = rows.where((F.col("_ord") >= 0) & (F.col("_ord") < len(contract.required)))
        return must.unionByName(rows.where(F.col("_ord") >= len(contract.required)).join(some, ["handoff_id", "_pos"], "left_semi")).drop("_ord", "_pos")

    f = f.with_(messages=of(f.messages, F.col("section"), "msg_idx"), artifacts=of(f.artifacts, F.lit("artifacts"), "art_idx"))
    # two codes at most
    for code in sorted(r[0] for r in v.where("code is not null").select("code").distinct().collect()):
        f = f.deny("receiver_contract", code, v.where(F.col("code") == code), written=True)
    return f


def compile_handoff(f: Frames, contract: Contract, cleanup: Sequence[Policy] = ()) -> Compilation:
    """Fit, clean up, fit again from the start (redaction may make items longer), render.

    Without a cleanup the second fit would be the first one again, so it is left out.
    """
    if contract.needs:
        raise ValueError("needs are for selection plans")
    source = envelope_sizes(f).select("handoff_id", F.col("tokens").alias("source_tokens"))
    f = f.with_(messages=classify(f.messages))
    before, kept = verdict(f, contract)
    after = before
    f = _keep(f, contract, before, kept)
    for policy in cleanup:
        f = policy(f.next())
    if cleanup:
        after, kept = verdict(f, contract)
        f = _keep(f, contract, after, kept)
    items = _kept(items_of(f, contract), after, kept)
    packet = packets.render(f.live().withColumn("goal", F.lit(contract.goal.strip())), items.select("handoff_id", "section", "pos", "item"))
    first = before.select("handoff_id", F.col("omitted").alias("omitted_before"), F.col("omitted_count").alias("n_before"))
    second = after.where("code is null").select("handoff_id", F.col("omitted").alias("omitted_after"), F.col("omitted_count").alias("n_after"), "used", "total")
    budget = source.join(first, "handoff_id").join(second, "handoff_id")
    more = F.col("n_after") if cleanup else F.lit(0)
    budget = budget.select(
        "handoff_id", "source_tokens", tk.tokens(F.col("total")).alias("packet_tokens"), F.col("total").alias("packet_bytes"), tk.tokens(F.col("used")).alias("required_tokens"), "omitted_before", "omitted_after",
        F.lit(contract.max_tokens).alias("max_tokens"), F.greatest(F.lit(contract.max_tokens) - tk.tokens(F.col("total")), F.lit(0)).alias("remaining_tokens"), (F.col("n_before") + more).alias("omitted_count"),
    )
    f = f.event("receiver_contract", "compiled", budget.select("handoff_id", F.col("omitted_count").alias("count")))
    return Compilation(packet, items, budget, f)


#: Frames to frames with sections set, and a report.
Normalizer = Callable[[Frames], tuple[Frames, DataFrame]]


def compile_history(f: Frames, contract: Contract, cleanup: Sequence[Policy] = (), *, normalizer: Normalizer = normalize_frames) -> tuple[Compilation, DataFrame]:
    """Normalize first, by rules or by any function of that shape; source tokens are those of the history as it came."""
    source = envelope_sizes(f).select("handoff_id", F.col("tokens").alias("source_tokens"))
    n, told = normalizer(f)
    out = compile_handoff(n, contract, cleanup)
    return Compilation(out.packets, out.items, out.budget.drop("source_tokens").join(source, "handoff_id"), out.frames), told

