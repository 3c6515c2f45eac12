"""Selection plans by an outside scorer: the request, its checks, and the fit of what was chosen.

The scorer is a boundary: a table of plans, or any function over the request table. Nothing here calls a network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions import tokens as tk
from relaypack.functions.text import bare_lines, is_blank, lines
from relaypack.operators.compiler import Contract
from relaypack.operators.spans import closure

SELECTIONS = "handoff_id bigint, rank int, unit_id string, section string, essential boolean"
COVERAGE = "handoff_id bigint, need int, unit_ids array<string>"


def insertion_estimates(units: DataFrame, needs: DataFrame | None = None) -> DataFrame:
    """handoff_id, unit_id, own_tokens, estimate: its content, ids and origin overhead, summed over all it depends on."""
    ident = tk.tokens(tk.literal_bytes(F.col("unit_id")) + 1) * F.when(F.col("origin") == "m", 2).otherwise(1)
    own = units.select("handoff_id", "unit_id", "origin", "idx", (tk.tokens(tk.literal_bytes(F.col("content")) + 1) + ident).alias("own_tokens"))
    head = units.select("handoff_id", "origin", "idx", tk.tokens(F.lit(24) + F.coalesce(tk.literal_bytes(F.col("role")), F.lit(0)) + tk.tags_bytes(F.col("tags"), wide=False)).alias("overhead")).dropDuplicates(["handoff_id", "origin", "idx"])
    needs = closure(units) if needs is None else needs
    cost = needs.join(own.select("handoff_id", F.col("unit_id").alias("needs"), F.col("own_tokens").alias("t")), ["handoff_id", "needs"]).groupBy("handoff_id", "unit_id").agg(F.sum("t").alias("deep"))
    return own.join(cost, ["handoff_id", "unit_id"]).join(head, ["handoff_id", "origin", "idx"]).select("handoff_id", "unit_id", "own_tokens", (F.col("deep") + F.col("overhead")).alias("estimate"))


def check_plan(units: DataFrame, plan: DataFrame, coverage: DataFrame, contract: Contract, handoffs: DataFrame) -> DataFrame:
    """handoff_id, code: the first rule that a plan breaks, in a fixed order. Sound plans have no row."""
    allowed = [*contract.required, *contract.preferred]
    n_needs = len(contract.needs)
    known = units.select("handoff_id", "unit_id", "origin")
    p = plan.join(known, ["handoff_id", "unit_id"], "left")
    twice = plan.groupBy("handoff_id", "unit_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    has = plan.groupBy("handoff_id").agg(F.collect_set("section").alias("s"))
    ids = handoffs.select("handoff_id")
    required = F.array(*map(F.lit, contract.required)).cast("array<string>")
    cov = coverage.withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy("handoff_id", "need")))
    chosen = plan.select("handoff_id", F.col("unit_id")).distinct().withColumn("there", F.lit(True))
    unpicked = coverage.select("handoff_id", F.explode("unit_ids").alias("unit_id")).join(chosen, ["handoff_id", "unit_id"], "left_anti")
    covered = coverage.groupBy("handoff_id").agg(F.count_distinct("need").alias("n"))
    rules = [
        ("unknown_unit", p.where("origin is null")),
        ("repeated_unit", twice),
        ("unrequested_section", plan.where(~F.col("section").isin(*allowed))),
        ("wrong_origin", p.where((F.col("origin") == "a") != (F.col("section") == "artifacts"))),
        ("empty_plan", ids.join(plan.select("handoff_id"), "handoff_id", "left_anti")),
        ("required_missing", ids.join(has, "handoff_id", "left").where(F.size(F.array_except(required, F.coalesce("s", F.array().cast("array<string>")))) > 0)),
        ("bad_need", cov.where(f"need < 0 or need >= {n_needs} or n_same > 1")),
        ("bad_sources", coverage.where("size(unit_ids) = 0 or size(unit_ids) <> size(array_distinct(unit_ids))")),
        ("source_not_selected", unpicked),
        ("need_uncovered", ids.join(covered, "handoff_id", "left").where(F.coalesce("n", F.lit(0)) < n_needs)),
    ]
    return first_broken(rules)


def first_broken(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """handoff_id, code: the first of some rules whose rows name the handoff."""
    out = None
    for i, (code, rows) in enumerate(rules):
        one = rows.select("handoff_id", F.lit(i).alias("i"), F.lit(code).alias("code"))
        out = one if out is None else out.unionAll(one)
    return out.groupBy("handoff_id").agg(F.min_by("code", "i").alias("code"))


def essential(plan: DataFrame, coverage: DataFrame, contract: Contract) -> DataFrame:
    """plan with ``must``: flagged, of a required section, or covering a need."""
    cover = coverage.select("handoff_id", F.explode("unit_ids").alias("unit_id")).distinct().withColumn("c", F.lit(True))
    must = F.col("essential") | F.col("section").isin(*contract.required) | F.coalesce("c", F.lit(False))
    return plan.join(cover, ["handoff_id", "unit_id"], "left").withColumn("must", must).drop("c")


def fit_plan(plan: DataFrame, needs: DataFrame, sizes: DataFrame, max_tokens: int, base_tokens: int = 0) -> DataFrame:
    """handoff_id, unit_id, via, rank, over: essentials with their context first, then optional ones by rank while their whole context fits.

    A unit that several candidates need is paid for once, so this is no plain fold; the units of one plan are handled together.
    ``plan``: handoff_id, rank, unit_id, must; ``needs``: closure(); ``sizes``: handoff_id, unit_id, tokens.
    """
    rows = plan.join(needs, ["handoff_id", "unit_id"]).join(sizes.select("handoff_id", F.col("unit_id").alias("needs"), "tokens"), ["handoff_id", "needs"])

    def run(table):
        import pyarrow as pa

        groups: dict[tuple, dict] = {}
        for r in table.select(["rank", "unit_id", "must", "needs", "tokens"]).to_pylist():
            groups.setdefault((not r["must"], r["rank"], r["unit_id"]), {})[r["needs"]] = r["tokens"]
        used, taken, out = base_tokens, set(), []
        for optional, rank, unit in sorted(groups):
            new = {u: t for u, t in groups[optional, rank, unit].items() if u not in taken}
            if optional and used + sum(new.values()) > max_tokens:
                continue
            used += sum(new.values())
            taken |= set(new)
            out += [(u, unit, rank) for u in sorted(new)]
        head = table.column("handoff_id")[0].as_py()
        n = len(out)
        return pa.table({
            "handoff_id": pa.array([head] * n, pa.int64()), "unit_id": pa.array([x[0] for x in out], pa.string()), "via": pa.array([x[1] for x in out], pa.string()),
            "rank": pa.array([x[2] for x in out], pa.int32()), "over": pa.array([used > max_tokens] * n, pa.bool_()),
        })

    return rows.select("handoff_id", "rank", "unit_id", "must", "needs", "tokens").groupBy("handoff_id").applyInArrow(run, "handoff_id bigint, unit_id string, via string, rank int, over boolean")


def unselected(units: DataFrame, plan: DataFrame, taken: DataFrame) -> DataFrame:
    """Units that neither the plan names nor the fit took."""
    keys = ["handoff_id", "unit_id"]
    return units.join(plan.select(*keys).unionAll(taken.select(*keys)).distinct(), keys, "left_anti")


# ---- statements and excerpts


def whole_sources(messages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """handoff_id, source_id, content, n_lines, numbered of each nonblank text source."""
    m = messages.where("content_type = 'text'").select("handoff_id", F.concat(F.lit("m"), F.col("msg_idx").cast("string")).alias("source_id"), "content")
    a = artifacts.where("content_type = 'text'").select("handoff_id", F.concat(F.lit("a"), F.col("art_idx").cast("string")).alias("source_id"), "content")
    numbered = F.array_join(F.transform(bare_lines(F.col("content")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    return m.unionByName(a).where(~is_blank(F.col("content"))).select("handoff_id", "source_id", "content", F.size(lines(F.col("content"))).alias("n_lines"), numbered.alias("numbered"))


def brief_text(status: str = "status", content: str = "content"):
    from relaypack.functions.patterns import STATUS_PREFIX

    prefix = F.element_at(F.create_map(*(F.lit(x) for p in STATUS_PREFIX.items() for x in p)), F.col(status))
    return F.concat(prefix, F.col(content))


def excerpts(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """wanted (handoff_id, source_id, first, last, ...) with ``excerpt``, its lines as they are, and ``code`` of the rule it breaks.

    Bounds count from 1 and are inclusive; both null mean the whole source. Excerpts of a source may not overlap.
    """
    w = Window.partitionBy("handoff_id", "source_id").orderBy("_f", "_l")
    x = wanted.join(sources.select("handoff_id", "source_id", lines(F.col("content")).alias("_lines"), "n_lines"), ["handoff_id", "source_id"], "left")  # split once, not for each range
    x = x.withColumns({"_f": F.coalesce("first", F.lit(1)), "_l": F.coalesce("last", "n_lines")})
    x = x.withColumn("_hit", F.coalesce(F.max("_l").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("_f"), F.lit(False)))
    inside = (F.col("_f") >= 1) & (F.col("_l") >= F.col("_f")) & (F.col("_l") <= F.col("n_lines"))
    cut = F.when(inside, F.array_join(F.slice("_lines", F.col("_f").cast("int"), (F.col("_l") - F.col("_f") + 1).cast("int")), ""))
    code = (
        F.when(F.col("_lines").isNull(), "unknown_source")
        .when(F.col("first").isNull() != F.col("last").isNull(), "one_bound")
        .when(~inside, "out_of_range")
        .when(is_blank(cut), "blank")
        .when(F.col("_hit"), "overlap")
    )
    return x.withColumns({"excerpt": cut, "code": code}).drop("_f", "_l", "_hit", "_lines", "n_lines")
