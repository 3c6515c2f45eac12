"""Queries: packets from a scorer's choice, over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.operators import model
from relaypack.operators.compiler import Contract
from relaypack.plans.common import conversation_frames
from relaypack.plans.text_queries import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


CONTRACT = Contract("g", ("decisions",), ("evidence",), 300, ("why",))
_BASE = 169 + 3 + 10 + 8
_FOLD = """fitted as (select conv_id, list_reduce(list_prepend({'i': -1, 'bytes': 0::bigint, 'used': need::bigint, 'n': 0, 'kept': []::int[]}, coalesce(xs, [])),
 lambda a, x: case when a.used + x.bytes + (a.n > 0)::int <= 1200 then {'i': -1, 'bytes': 0::bigint, 'used': (a.used + x.bytes + (a.n > 0)::int)::bigint, 'n': a.n + 1, 'kept': list_append(a.kept, x.i)} else a end) as s from must left join rest using (conv_id))"""
_UNITS = """l as (select conv_id, turn, role, unnest(ls) as line, generate_subscripts(ls, 1) as k, len(ls) as n from (select *, string_split(text, chr(10)) as ls from conversations)),
u as (select conv_id, turn, role, line || case when k < n then chr(10) else '' end as line, (row_number() over (partition by conv_id, turn order by k) - 1)::int as part, (row_number() over (partition by conv_id order by turn, k) - 1)::int as i from l where trim(line, E' \\t') <> ''),
b as (select *, 'm' || turn || '.' || part as id, 12 + strlen(to_json(line)::varchar) + case when i = 0 then 19 else 18 end + 12 + strlen('{"relaypack.source_id":"m' || turn || '.' || part || '"}') + case when role <> 'user' then 8 + strlen(to_json(role)::varchar) else 0 end as bytes from u)"""


def _selector(request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first line is what was decided, and the reason; every other line of the assistant may go along."""
    w = request.select("handoff_id", "unit_id", "idx", "part", "role")
    first = w.groupBy("handoff_id").agg(F.min_by("unit_id", F.struct("idx", "part")).alias("head"))
    w = w.join(first, "handoff_id").withColumn("must", F.col("unit_id") == F.col("head"))
    picked = w.where("must or (role = 'assistant' and part % 2 = 0)")
    rank = F.when(F.col("must"), 0).otherwise(F.col("idx") * 100_000 + F.col("part") + 1).cast("int")
    plan = picked.select("handoff_id", rank.alias("rank"), "unit_id", F.when(F.col("must"), "decisions").otherwise("evidence").alias("section"), F.col("must").alias("essential"))
    return plan, first.select("handoff_id", F.lit(0).alias("need"), F.array("head").alias("unit_ids"))


_PICKED = f"""{_UNITS}, must as (select conv_id, {_BASE} + bytes as need, id from b where i = 0 and {_BASE} + bytes <= 1200),
rest as (select conv_id, list({{'i': i, 'bytes': bytes::bigint, 'used': 0::bigint, 'n': 0, 'kept': []::int[]}} order by turn, part) as xs from b where i > 0 and role = 'assistant' and part % 2 = 0 group by conv_id), {_FOLD}"""


@query(f"with {_PICKED} select conv_id, 'm0.0' as unit_id, 'decisions' as section, true as kept from must union all select conv_id, id, 'evidence', list_contains(s.kept, i) from b join fitted using (conv_id) where i > 0 and role = 'assistant' and part % 2 = 0".replace("'m0.0' as unit_id", "id as unit_id"))
def model_selection_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the planned units each packet has."""
    out = model.compile_selected(conversation_frames(spark, sf_dir), CONTRACT, _selector)
    first = F.struct(F.lit("decisions").alias("section"), F.lit(True).alias("kept"), F.slice(F.col("selected"), 1, 1).alias("ids"))
    more = F.struct(F.lit("evidence").alias("section"), F.lit(True).alias("kept"), F.expr("slice(selected, 2, 1 << 30)").alias("ids"))
    left = F.struct(F.lit("evidence").alias("section"), F.lit(False).alias("kept"), F.col("omitted").alias("ids"))
    each = out.report.select("handoff_id", F.explode(F.array(first, more, left)).alias("x"))
    return each.select(F.col("handoff_id").alias("conv_id"), F.explode("x.ids").alias("unit_id"), "x.section", "x.kept")


@query(f"with {_PICKED} select conv_id, s.used as packet_bytes, (1 + len(s.kept))::bigint as n_items from fitted")
def model_handoff_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered packets have the bytes that the fit counted."""
    out = model.compile_selected(conversation_frames(spark, sf_dir), CONTRACT, _selector)
    return out.compiled.packets.select(F.col("handoff_id").alias("conv_id"), "packet_bytes", "n_items")


_TIGHT = Contract("g", ("decisions",), ("evidence",), 95, ("why",))


@query(f"with {_UNITS} select conv_id, 'budget_exceeded' as code from b where i = 0 and {_BASE} + bytes > 380")
def model_handoff_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model.compile_selected(conversation_frames(spark, sf_dir), _TIGHT, _selector)
    return out.compiled.frames.denials.select(F.col("handoff_id").alias("conv_id"), "code")


def _composer(request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One statement on the first message; all messages as optional excerpts, the first two lines of those of the assistant."""
    place = F.substring("source_id", 2, 9).cast("int")
    brief = request.groupBy("handoff_id").agg(F.min(place).alias("p"))
    brief = brief.select("handoff_id", F.lit(0).alias("i"), F.lit("decisions").alias("section"), F.concat(F.lit("n"), F.col("handoff_id").cast("string")).alias("content"), F.array(F.concat(F.lit("m"), F.col("p").cast("string"))).alias("source_ids"), F.array(F.lit(0)).alias("needs"), F.lit("uncertain").alias("status"))
    cut = F.when(place % 2 == 1, F.least(F.lit(2), F.col("n_lines")))
    wanted = request.select("handoff_id", place.alias("i"), "source_id", F.lit("evidence").alias("section"), F.when(cut.isNotNull(), 1).alias("first"), cut.cast("int").alias("last"), F.lit(False).alias("essential"))
    return brief, wanted


_BRIEF = f"""ls as (select conv_id, turn, role, text, string_split(case when text like '%' || chr(10) then text[:-2] else text end, chr(10)) as ls from conversations where regexp_matches(text, '\\S')),
c as (select conv_id, turn, role, least(2, len(ls)) as last, case when turn % 2 = 1 then case when len(ls) > 2 or text like '%' || chr(10) and len(ls) = 2 then array_to_string(ls[1:2], chr(10)) || chr(10) else text end else text end as content from ls),
b as (select conv_id, turn::int as i, 12 + strlen(to_json(content)::varchar) + 18 + 12 + strlen('{{' || case when turn % 2 = 1 then '"relaypack.excerpt_lines":[1,' || last || '],' else '' end || '"relaypack.excerpt_source":"m' || turn || '","relaypack.item":"e' || turn || '"}}') + case when role <> 'user' then 8 + strlen(to_json(role)::varchar) else 0 end as bytes from c),
must as (select conv_id, {_BASE} + 12 + strlen(to_json('[Unverified] n' || conv_id)::varchar) + 19 + 12 + strlen('{{"relaypack.brief_sources":["m' || min(turn) || '"],"relaypack.brief_status":"uncertain","relaypack.item":"b0"}}') + 19 as need from c group by conv_id),
rest as (select conv_id, list({{'i': i, 'bytes': bytes::bigint, 'used': 0::bigint, 'n': 0, 'kept': []::int[]}} order by i) as xs from b group by conv_id), {_FOLD}"""


@query(f"with {_BRIEF} select conv_id, s.used as packet_bytes, s.kept as kept from fitted")
def brief_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief that stays, and the excerpts that fit beside it."""
    out, fit = model.compile_brief(conversation_frames(spark, sf_dir), CONTRACT, _composer)
    told = out.packets.join(fit.select("handoff_id", "kept"), "handoff_id")
    return told.select(F.col("handoff_id").alias("conv_id"), "packet_bytes", "kept")
