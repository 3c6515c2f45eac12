"""Packets from an outside scorer's choice: source units by its ranking, or a brief with excerpts, fitted to the exact bytes.

The scorer is a boundary: a function from the request table to its plan, or the plan's tables themselves. What it says is
checked against the sources before anything is fitted; a broken plan denies its handoff. Bytes are additive but for
units that become one item with the unit before, so the fit of ranked units goes over one handoff's units at a time in
an Arrow function; briefs and excerpts are a fold over integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions import tokens as tk
from relaypack.operators import selection as se
from relaypack.operators import spans as sp
from relaypack.operators.compiler import Compilation, Contract, compile_handoff
from relaypack.operators.frames import Frames, Policy, envelope_sizes
from relaypack.operators.payloads import RESERVED, json_text
from relaypack.operators.shared import cut
from relaypack.schema import SECTIONS

BRIEF = "handoff_id bigint, i int, section string, content string, source_ids array<string>, needs array<int>, status string"
EXCERPTS = "handoff_id bigint, i int, source_id string, section string, first int, last int, essential boolean"
_LIST_KEY = len(',"relaypack.source_ids":[]')


@dataclass(frozen=True)
class Selected:
    compiled: Compilation
    #: handoff_id, source_units, selected, context, omitted, unselected (unit ids).
    report: DataFrame


def with_keys(metadata_json: Column, new: dict[str, Column]) -> Column:
    """Metadata with engine keys (JSON texts; null: left out) in place of any that the sender set; keys are sorted."""
    held = F.transform_values(F.map_filter(F.from_json(metadata_json, "map<string,variant>"), lambda k, _: ~k.isin(*RESERVED)), lambda _, v: F.to_json(v))
    own = F.map_filter(F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    every = F.map_concat(F.when(metadata_json == "{}", F.create_map().cast("map<string,string>")).otherwise(held), own)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(every)), lambda k: F.concat(json_text(k), F.lit(":"), F.element_at(every, k))), ","), F.lit("}"))


def _base(f: Frames, contract: Contract) -> DataFrame:
    return f.live().select("handoff_id", tk.packet_base(F.col("sender"), F.col("receiver"), F.lit(contract.goal.strip())).cast("bigint").alias("base"))


def _plain_tags(tags: Column) -> Column:
    return F.array_except(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, SECTIONS)))


def _priced(f: Frames, units: DataFrame) -> DataFrame:
    """Units with head (bytes of an item of theirs without content and kind), piece (bytes of the content) and gap (of the blank text before it)."""
    quoted = lambda c: tk.literal_bytes(c) - 2
    ident = json_text(F.col("unit_id"))
    m = f.messages.select("handoff_id", F.col("msg_idx").alias("idx"), "content_type", F.col("content").alias("whole"), F.col("metadata_json"), F.col("role").alias("_role"), _plain_tags(F.col("tags")).alias("_tags"))
    u = units.where("origin = 'm'").drop("role", "tags").join(m, ["handoff_id", "idx"]).withColumnsRenamed({"_role": "role", "_tags": "tags"})
    before = F.lag("end").over(Window.partitionBy("handoff_id", "idx").orderBy("part"))
    gap = F.when(before < F.col("start"), F.substring(F.col("whole"), before + 1, F.col("start") - before)).otherwise("")
    piece = F.when(F.col("content_type") == "text", quoted(F.col("content"))).otherwise(tk.json_bytes(F.col("content"), wide=False) - 2)
    u = u.withColumns({"piece": piece, "gap": quoted(gap)})
    bare = u.withColumns({"_c": F.col("content"), "_t": F.col("content_type"), "content": F.lit(""), "content_type": F.lit("text"), "kind": F.lit("message"), "metadata_json": with_keys(F.col("metadata_json"), {"relaypack.source_id": ident})})
    m_out = bare.withColumn("head", tk.message_bytes(wide=False)).select("handoff_id", "unit_id", "origin", "idx", "part", "context", "head", "piece", "gap")
    a = f.artifacts.select("handoff_id", F.col("art_idx").alias("idx"), "name", "media_type", "content_type", F.col("metadata_json"))
    x = units.where("origin = 'a'").drop("content_type").join(a, ["handoff_id", "idx"]).withColumn("metadata_json", with_keys(F.col("metadata_json"), {"relaypack.source_id": ident}))
    a_out = x.withColumn("head", tk.artifact_bytes(wide=False)).select("handoff_id", "unit_id", "origin", "idx", "part", "context", "head", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("gap"))
    return m_out.unionByName(a_out)


class _Fitted:
    """Bytes of a set of chosen units of one handoff, kept by origin and section."""

    def __init__(self, units: dict[str, dict], base: int):
        self.units, self.base = units, base
        self.chosen: dict[str, str] = {}

    def size(self, more: dict[str, str] | None = None) -> int:
        chosen = self.chosen | (more or {})
        order = sorted(chosen, key=lambda u: (self.units[u]["origin"], self.units[u]["idx"], self.units[u]["part"]))
        total, items, run, last = self.base, {}, 0, None
        for name in order:
            u, section = self.units[name], chosen[name]
            if last and u["origin"] == "m" and (last["idx"], last["part"] + 1) == (u["idx"], u["part"]) and last["origin"] == "m" and chosen[last["unit_id"]] == section:
                total += u["piece"] + u["gap"] + len(u["unit_id"]) + 3 + (_LIST_KEY + len(last["unit_id"]) + 2 if run == 1 else 0)
                run += 1
            else:
                total += u["head"] + u["piece"] + (len(section) + 10 if u["origin"] == "m" else 0) + (section in items)
                items[section] = True
                run = 1
            last = u
        return total

    def around(self, wanted: dict[str, str]) -> dict[str, str]:
        """Units with all their context, which has the section of what needs it unless it is chosen itself."""
        out: dict[str, str] = {}
        stack = list(reversed(wanted.items()))
        while stack:
            name, section = stack.pop()
            if name in self.chosen or name in out:
                continue
            out[name] = wanted.get(name, section)
            stack += [(c, section) for c in self.units[name]["context"]]
        return out


_ROWS = 1 << 14


def fit_units(priced: DataFrame, plan: DataFrame, heads: DataFrame, max_bytes: int) -> DataFrame:
    """handoff_id, place, unit_id, section, planned, state (kept or omitted), total: essentials and their context, then optional units by
    rank while the whole packet fits. Essentials alone over the limit give one row, ``over``.

    One handoff's units are handled together, its units and its plan being rows of one sorted table; ``plan``: handoff_id, rank, unit_id,
    section, must; ``heads``: handoff_id, base.
    """
    wide = plan.join(heads, "handoff_id").select("handoff_id", "unit_id", "rank", "section", "must", "base")
    both = priced.select("handoff_id", "unit_id", "origin", "idx", "part", "context", "head", "piece", "gap").unionByName(wide, allowMissingColumns=True)
    both = both.repartition("handoff_id").sortWithinPartitions("handoff_id")
    names = ["handoff_id", "place", "unit_id", "section", "planned", "state", "total"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()]

    def fitted(who: int, units: list[dict], picks: list[dict]) -> list[tuple]:
        if not picks:
            return []
        picks.sort(key=lambda r: r["rank"])
        fit = _Fitted({u["unit_id"]: u for u in units}, picks[0]["base"])
        planned = {p["unit_id"] for p in picks}
        fit.chosen = fit.around({p["unit_id"]: p["section"] for p in picks if p["must"]})
        if fit.size() > max_bytes:
            return [(who, 0, None, None, None, "over", fit.size())]
        omitted = []
        for p in picks:
            if p["unit_id"] not in fit.chosen:
                more = fit.around({p["unit_id"]: p["section"]})
                if fit.size(more) <= max_bytes:
                    fit.chosen |= more
                else:
                    omitted.append((p["unit_id"], p["section"]))
        total = fit.size()
        rows = [(who, i, u, s, u in planned, "kept", total) for i, (u, s) in enumerate(fit.chosen.items())]
        return rows + [(who, i, u, s, True, "omitted", total) for i, (u, s) in enumerate(omitted, len(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        who, units, picks, out = None, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["handoff_id"] != who:
                    out += fitted(who, units, picks)
                    who, units, picks = row["handoff_id"], [], []
                (units if row["base"] is None else picks).append(row)
            if len(out) >= _ROWS:
                yield table(out)
                out = []
        yield table(out + fitted(who, units, picks))

    return both.mapInArrow(run, "handoff_id bigint, place int, unit_id string, section string, planned boolean, state string, total bigint")


def _as_frames(f: Frames, units: DataFrame, kept: DataFrame) -> Frames:
    """The chosen units as protected messages and artifacts: adjacent ones of one message and section are one, in source order."""
    u = kept.select("handoff_id", "unit_id", F.col("section").alias("_s")).join(units.select("handoff_id", "unit_id", "origin", "idx", "part", "start", "end"), ["handoff_id", "unit_id"])
    w = Window.partitionBy("handoff_id", "origin", "idx").orderBy("part")
    fresh = ~(F.lag("part").over(w) + 1).eqNullSafe(F.col("part")) | ~F.lag("_s").over(w).eqNullSafe(F.col("_s"))
    runs = u.where("origin = 'm'").withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("handoff_id", "idx", "_run", "_s").agg(F.array_sort(F.collect_list(F.struct("part", "unit_id", "start", "end"))).alias("xs"))
    ids = F.transform("xs", lambda x: json_text(x["unit_id"]))
    keys = {"relaypack.source_id": F.get(ids, 0), "relaypack.source_ids": F.when(F.size("xs") > 1, F.concat(F.lit("["), F.array_join(ids, ","), F.lit("]")))}
    first, last = F.get(F.col("xs"), 0), F.element_at("xs", -1)
    m = f.messages.withColumnRenamed("msg_idx", "idx").drop("section", "kind", "protected").join(runs, ["handoff_id", "idx"])
    m = m.withColumns({
        "content": F.when(F.col("content_type") == "text", F.substring(F.col("content"), first["start"] + 1, last["end"] - first["start"])).otherwise(F.col("content")), "metadata_json": with_keys(F.col("metadata_json"), keys),
        "tags": _plain_tags(F.col("tags")), "kind": F.col("_s"), "section": F.col("_s"), "protected": F.lit(True),
        "msg_idx": (F.row_number().over(Window.partitionBy("handoff_id").orderBy("idx", "_run")) - 1).cast("int"),
    })
    a = f.artifacts.join(u.where("origin = 'a'").select("handoff_id", F.col("idx").alias("art_idx"), "unit_id"), ["handoff_id", "art_idx"])
    a = a.withColumns({"metadata_json": with_keys(F.col("metadata_json"), {"relaypack.source_id": json_text(F.col("unit_id"))}), "protected": F.lit(True)})
    return f.with_(messages=m.select(*f.messages.columns), artifacts=a.select(*f.artifacts.columns))


def _compiled(f: Frames, chosen: Frames, contract: Contract, cleanup: Sequence[Policy], policy: str) -> Compilation:
    """Compile what is chosen; a cleanup that takes any of it away denies the handoff."""
    sections = tuple(dict.fromkeys((*contract.required, *contract.preferred)))
    n = chosen.messages.select("handoff_id").unionAll(chosen.artifacts.select("handoff_id")).groupBy("handoff_id").agg(F.count(F.lit(1)).alias("n"))
    out = compile_handoff(chosen, Contract(contract.goal, (), sections, contract.max_tokens), cleanup)
    done = out.frames
    if cleanup:
        left = out.items.groupBy("handoff_id").agg(F.count(F.lit(1)).alias("left"))
        lost = n.join(left, "handoff_id", "left").join(done.live().select("handoff_id"), "handoff_id", "left_semi").where(F.coalesce("left", F.lit(0)) < F.col("n"))
        done = done.deny(policy, "contract", lost)
    live = done.live().select("handoff_id")
    semi = lambda d: d.join(live, "handoff_id", "left_semi")
    source = envelope_sizes(f).select("handoff_id", F.col("tokens").alias("source_tokens"))
    return Compilation(semi(out.packets).where("n_items > 0"), semi(out.items), semi(out.budget.drop("source_tokens")).join(source, "handoff_id"), done)


def compile_selected(f: Frames, contract: Contract, selector: Callable[[DataFrame], tuple[DataFrame, DataFrame]], cleanup: Sequence[Policy] = ()) -> Selected:
    """Ask a selector for a plan over each handoff's source units, check it, fit it, and compile what was chosen.

    The selector gets units with their estimates and gives (plan, coverage), shaped as selection.SELECTIONS and COVERAGE. It is
    asked once; handoffs without a source, or whose goal alone is over the budget, are denied before.
    """
    base = _base(f, contract)
    units = cut(sp.source_units(f), "units")
    none = f.live().select("handoff_id").join(units.select("handoff_id"), "handoff_id", "left_anti")
    f = f.deny("model_selector", "budget_exceeded", base.where(F.col("base") > contract.max_bytes)).deny("model_selector", "contract", none)
    live = f.live().select("handoff_id")
    units = units.join(live, "handoff_id", "left_semi")
    estimates = se.insertion_estimates(units).select("handoff_id", "unit_id", "estimate")
    plan, coverage = selector(cut(units.join(estimates, ["handoff_id", "unit_id"]), "request"))  # a selector reads it several times
    plan, coverage = cut(plan.join(live, "handoff_id", "left_semi"), "plan"), cut(coverage.join(live, "handoff_id", "left_semi"), "coverage")
    f = f.deny("model_selector", "contract", se.check_plan(units, plan, coverage, contract, live))
    live = f.live().select("handoff_id")
    must = se.essential(plan.join(live, "handoff_id", "left_semi"), coverage, contract)
    fitted = cut(fit_units(_priced(f, units), must, base, contract.max_bytes), "fitted")
    f = f.deny("model_selector", "budget_exceeded", fitted.where("state = 'over'"))
    kept = fitted.where("state = 'kept'")
    f = f.deny("model_selector", "budget_exceeded", f.live().select("handoff_id").join(kept.select("handoff_id"), "handoff_id", "left_anti"))
    f = f.event("model_selector", "selected", kept.groupBy("handoff_id").agg(F.count(F.lit(1)).alias("count")))
    out = _compiled(f, _as_frames(f, units, kept), contract, cleanup, "model_selector")
    keys = ["handoff_id", "unit_id"]
    state = F.coalesce(F.when((F.col("state") == "kept") & ~F.col("planned"), "context"), "state", F.lit("unselected"))
    told = units.select(*keys, "origin", "idx", "part").join(fitted.where("unit_id is not null").select(*keys, "state", "planned"), keys, "left").join(plan.select(*keys, F.lit(True).alias("p")), keys, "left")
    told = told.withColumn("state", F.when(F.col("state").isNull() & F.col("p"), "omitted").otherwise(state))
    ids = lambda *s: F.transform(F.array_sort(F.collect_list(F.when(F.col("state").isin(*s), F.struct("origin", "idx", "part", "unit_id")))), lambda x: x["unit_id"])
    report = told.groupBy("handoff_id").agg(F.count(F.lit(1)).alias("source_units"), ids("kept", "context").alias("selected"), ids("context").alias("context"), ids("omitted").alias("omitted"), ids("unselected").alias("unselected"))
    return Selected(out, report.join(out.frames.live().select("handoff_id"), "handoff_id", "left_semi"))


# ---- briefs and excerpts


def check_brief(brief: DataFrame, sources: DataFrame, contract: Contract, handoffs: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """handoff_id, code: the first rule that a brief breaks. ``missing``: handoff_id of those whose composer says that a need is missing."""
    allowed = [s for s in (*contract.required, *contract.preferred) if s != "artifacts"]
    n = len(contract.needs)
    blank = lambda c: ~F.col(c).rlike(r"\S")
    cited = brief.select("handoff_id", "i", F.explode("source_ids").alias("source_id")).join(sources.select("handoff_id", "source_id"), ["handoff_id", "source_id"], "left_anti")
    covered = brief.select("handoff_id", F.explode("needs").alias("need")).groupBy("handoff_id").agg(F.count_distinct("need").alias("n"))
    ids = handoffs.select("handoff_id")
    rules = [
        ("unrequested_section", brief.where(~F.col("section").isin(*allowed))),
        ("empty_statement", brief.where(blank("content") | (F.size("source_ids") == 0))),
        ("repeated_source", brief.where(F.size("source_ids") != F.size(F.array_distinct("source_ids")))),
        ("unknown_source", cited),
        ("bad_need", brief.where((F.size("needs") != F.size(F.array_distinct("needs"))) | F.exists("needs", lambda x: (x < 0) | (x >= n)))),
        ("need_missing", ids.join(covered, "handoff_id", "left").where(F.coalesce("n", F.lit(0)) < n)),
        ("empty_brief", ids.join(brief.select("handoff_id"), "handoff_id", "left_anti")),
    ]
    if missing is not None:
        rules.insert(5, ("need_missing", ids.join(missing, "handoff_id", "left_semi")))
    return se.first_broken(rules)


def check_excerpts(wanted: DataFrame, sources: DataFrame, contract: Contract) -> DataFrame:
    """handoff_id, code: the first rule that a handoff's excerpts break; ``wanted`` as selection.excerpts gives them."""
    of = wanted.join(sources.select("handoff_id", "source_id", "content_type"), ["handoff_id", "source_id"], "left")
    artifact = F.col("source_id").startswith("a")
    whole = F.col("first").isNull() & F.col("last").isNull()
    return se.first_broken([
        ("unknown_source", of.where("content_type is null")),
        ("unrequested_section", of.where(~F.col("section").isin(*contract.required, *contract.preferred))),
        ("wrong_origin", of.where(artifact != (F.col("section") == "artifacts"))),
        ("atomic_source", of.where(~whole & (artifact | (F.col("content_type") != "text")))),
        ("bad_bounds", of.where(F.col("code").isNotNull())),
    ])


def _sources(f: Frames) -> DataFrame:
    """handoff_id, source_id, content, content_type of each nonblank source, whole."""
    m = f.messages.select("handoff_id", F.concat(F.lit("m"), F.col("msg_idx").cast("string")).alias("source_id"), "content", "content_type")
    a = f.artifacts.select("handoff_id", F.concat(F.lit("a"), F.col("art_idx").cast("string")).alias("source_id"), "content", "content_type")
    return m.unionByName(a).where(F.col("content").rlike(r"\S"))


def _items(f: Frames, brief: DataFrame, taken: DataFrame, contract: Contract) -> DataFrame:
    """Brief statements and excerpts as rows of one shape: message columns, section, origin, i, must, bytes."""
    quoted = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x)), ","), F.lit("]"))
    empty = F.array().cast("array<string>")
    b = brief.select(
        "handoff_id", F.lit("b").alias("origin"), "i", "section", F.lit("assistant").alias("role"), F.lit("text").alias("content_type"), se.brief_text().alias("content"), empty.alias("tags"), F.lit(True).alias("must"), F.lit(None).cast("int").alias("art_idx"),
        with_keys(F.lit("{}"), {"relaypack.brief_sources": quoted(F.col("source_ids")), "relaypack.brief_status": json_text(F.col("status")), "relaypack.item": json_text(F.concat(F.lit("b"), F.col("i").cast("string")))}).alias("metadata_json"),
    )
    must = F.col("essential") | F.col("section").isin(*contract.required)
    lines = F.when(F.col("first").isNotNull(), F.concat(F.lit("["), F.col("first").cast("string"), F.lit(","), F.col("last").cast("string"), F.lit("]")))
    keys = {"relaypack.excerpt_source": json_text(F.col("source_id")), "relaypack.item": json_text(F.concat(F.lit("e"), F.col("i").cast("string"))), "relaypack.excerpt_lines": lines}
    m = f.messages.select("handoff_id", F.concat(F.lit("m"), F.col("msg_idx").cast("string")).alias("source_id"), "role", "content_type", F.col("content").alias("_whole"), "tags", F.col("metadata_json").alias("_meta"))
    e = taken.join(m, ["handoff_id", "source_id"]).select(
        "handoff_id", F.lit("e").alias("origin"), "i", "section", "role", "content_type", F.when(F.col("first").isNull(), F.col("_whole")).otherwise(F.col("excerpt")).alias("content"), F.coalesce("tags", empty).alias("tags"), must.alias("must"), F.lit(None).cast("int").alias("art_idx"),
        with_keys(F.col("_meta"), keys).alias("metadata_json"),
    )
    a = f.artifacts.select("handoff_id", F.concat(F.lit("a"), F.col("art_idx").cast("string")).alias("source_id"), "art_idx", "name", "media_type", "content_type", F.col("content").alias("_whole"), F.col("metadata_json").alias("_meta"))
    x = taken.join(a, ["handoff_id", "source_id"]).select(
        "handoff_id", F.lit("a").alias("origin"), "i", "section", F.lit(None).cast("string").alias("role"), "content_type", F.col("_whole").alias("content"), empty.alias("tags"), must.alias("must"), "art_idx", with_keys(F.col("_meta"), keys).alias("metadata_json"), "name", "media_type"
    ).withColumn("bytes", tk.artifact_bytes(wide=False))
    both = b.unionByName(e).withColumn("kind", F.col("section"))
    return both.withColumn("bytes", tk.message_bytes(wide=False)).drop("kind").unionByName(x.drop("name", "media_type"))


_STATE = "struct<used:bigint,filled:int,kept:array<int>>"


def fit_items(items: DataFrame, base: DataFrame, max_bytes: int) -> DataFrame:
    """handoff_id, used, kept (i of optional items), omitted, total: what must be there, then optional items in order while they fit.

    An item costs a byte more, its comma, where its section has one already. ``items``: handoff_id, i, section, must, bytes.
    """
    bit = F.element_at(F.create_map(*(x for k, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(1 << k)))), F.col("section"))
    told = items.withColumn("bit", bit)
    by = told.groupBy("handoff_id").agg(
        F.sum(F.when(F.col("must"), F.col("bytes") + 1).otherwise(0)).alias("need"), F.count_distinct(F.when(F.col("must"), F.col("section"))).alias("sections"), F.bit_or(F.when(F.col("must"), F.col("bit")).otherwise(0)).alias("filled"),
        F.array_sort(F.collect_list(F.when(~F.col("must"), F.struct("i", "bit", "bytes")))).alias("xs"),
    )

    def step(a: Column, x: Column) -> Column:
        total = a["used"] + x["bytes"] + F.when(a["filled"].bitwiseAND(x["bit"]) > 0, 1).otherwise(0)
        return F.when(total <= max_bytes, F.struct(total.alias("used"), a["filled"].bitwiseOR(x["bit"]).alias("filled"), F.array_append(a["kept"], x["i"]).alias("kept")).cast(_STATE)).otherwise(a)

    d = base.join(by, "handoff_id").withColumn("used", (F.col("base") + F.col("need") - F.col("sections")).cast("bigint"))
    begin = F.struct(F.col("used"), F.col("filled").cast("int").alias("filled"), F.array().cast("array<int>").alias("kept")).cast(_STATE)
    d = d.withColumn("s", F.when(F.col("used") <= max_bytes, F.aggregate("xs", begin, step)))
    return d.select("handoff_id", "used", F.col("s.kept").alias("kept"), F.array_except(F.transform("xs", lambda x: x["i"]), F.col("s.kept")).alias("omitted"), F.col("s.used").alias("total"))


def compile_brief(f: Frames, contract: Contract, composer: Callable[[DataFrame], tuple[DataFrame, DataFrame]], cleanup: Sequence[Policy] = ()) -> tuple[Compilation, DataFrame]:
    """(compilation, fit): a composer's brief, which stays whole, with original excerpts: essential ones and those of required sections stay too,
    the others while they fit. Overflow denies; nothing is rewritten or asked again.

    The composer gets the whole sources with numbered lines and gives (brief, excerpts), shaped as BRIEF and EXCERPTS.
    """
    if not any(s != "artifacts" for s in (*contract.required, *contract.preferred)):
        raise ValueError("a brief needs a section for messages")
    base = _base(f, contract)
    sources = cut(_sources(f), "sources")
    none = f.live().select("handoff_id").join(sources.select("handoff_id"), "handoff_id", "left_anti")
    f = f.deny("hybrid_composer", "budget_exceeded", base.where(F.col("base") > contract.max_bytes)).deny("hybrid_composer", "contract", none)
    live = f.live().select("handoff_id")
    brief, wanted = composer(se.whole_sources(f.messages, f.artifacts).join(live, "handoff_id", "left_semi"))
    brief, wanted = cut(brief.join(live, "handoff_id", "left_semi"), "brief"), cut(wanted.join(live, "handoff_id", "left_semi"), "excerpts")
    f = f.deny("hybrid_composer", "contract", check_brief(brief, sources, contract, live))
    texts = sources.withColumn("n_lines", F.when(F.col("content_type") == "text", F.size(se.lines(F.col("content")))).otherwise(1))
    taken = cut(se.excerpts(wanted, texts), "taken")
    f = f.deny("hybrid_composer", "contract", check_excerpts(taken, sources, contract))
    live = f.live().select("handoff_id")
    items = cut(_items(f, brief, taken, contract).join(live, "handoff_id", "left_semi"), "items")
    held = items.where("must").groupBy("handoff_id").agg(F.collect_set("section").alias("s"))
    need = F.array(*map(F.lit, contract.required)).cast("array<string>")
    lacking = live.join(held, "handoff_id", "left").where(F.size(F.array_except(need, F.coalesce("s", F.array().cast("array<string>")))) > 0)
    f = f.deny("hybrid_composer", "contract", lacking)
    fitted = cut(fit_items(items, base, contract.max_bytes), "fitted")
    f = f.deny("hybrid_composer", "budget_exceeded", fitted.where("total is null"))
    some = items.join(fitted.select("handoff_id", "kept"), "handoff_id").where(F.col("must") | F.array_contains("kept", F.col("i"))).join(f.live().select("handoff_id"), "handoff_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("handoff_id").orderBy(F.col("origin"), F.when(F.col("must"), 0).otherwise(1), "i")) - 1
    m = some.where("origin <> 'a'").withColumns({"kind": F.col("section"), "protected": F.lit(True), "src_key": F.lit(None).cast("string"), "msg_idx": place.cast("int")})
    kept_art = some.where("origin = 'a'").select("handoff_id", "art_idx", F.col("metadata_json").alias("_meta"))
    a = f.artifacts.join(kept_art, ["handoff_id", "art_idx"]).withColumns({"metadata_json": F.col("_meta"), "protected": F.lit(True)})
    f = f.event("hybrid_composer", "composed", brief.groupBy("handoff_id").agg(F.count(F.lit(1)).alias("count")))
    out = _compiled(f, f.with_(messages=m.select(*f.messages.columns), artifacts=a.select(*f.artifacts.columns)), contract, cleanup, "hybrid_composer")
    return out, fitted.join(out.frames.live().select("handoff_id"), "handoff_id", "left_semi")
