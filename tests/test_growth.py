"""Plans that do each step once, so that their cost grows with the input only."""

import random

from pyspark.sql import functions as F

from relaypack.functions import classify, text
from relaypack.operators import model, normalize, spans
from relaypack.operators.compiler import Contract
from relaypack.operators.frames import frames, text_messages
from relaypack.plans import history


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _listing(rows, end="\n"):
    return f"File: a.py ({len(rows)} lines)\n" + end.join(f"{i}: {x}" for i, x in enumerate(rows, 7))


def _units(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "h bigint, t string")
    m = text_messages(rows, F.col("h"), F.lit(0), F.lit("tool"), F.col("t"))
    heads = rows.selectExpr("h as handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json")
    return spans.source_units(frames(spark, heads, m))


def test_listings_are_cut_once(spark):
    plan = _plan(_units(spark, ["x"]))
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_closure_computes_its_units_once(spark):
    plan = _plan(spans.closure(_units(spark, ["x"])))
    assert plan.count("MapInArrow") == 2 and "Join" not in plan  # the listings and the closure itself


def test_broken_listings_are_tiled_as_other_texts(spark):
    texts = [_listing(["a", "b"]) + "\n9: x\n", _listing(["a"]) + "\n```\n\n x\n```\n \n é", _listing(["if x:", "  y"], "\r\n"), _listing(["if x:", "  y\x0b9: z"])]
    got = {}
    for r in _units(spark, texts).orderBy("handoff_id", "part").collect():
        assert texts[r.handoff_id][r.start : r.end] == r.content and r.part == len(got.get(r.handoff_id, []))
        got.setdefault(r.handoff_id, []).append(r.content)
    m = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "handoff_id bigint, msg_idx int, content string")
    tiled = {}
    for r in spans.text_spans(m).select("handoff_id", "_s.*").orderBy("handoff_id", "part").collect():
        tiled.setdefault(r.handoff_id, []).append(r.content)
    assert got[1] == tiled[1] and got[0] == [texts[0][:21], texts[0][21:]] and got[2] == [texts[2][:21], texts[2][21:]]


def test_closure_of_a_long_chain(spark):
    r = random.Random(5)
    ids = [f"u{i}" for i in range(300)]
    context = {u: sorted({ids[i - 1], *r.sample(ids[:i], min(i, 2))}) if i and i % 50 else [] for i, u in enumerate(ids)}
    rows = [(h, "m", 0, u, context[u]) for h in (1, 2) for u in ids] + [(3, "m", k, "p", []) for k in range(2)]
    df = spark.createDataFrame(rows, "handoff_id bigint, origin string, idx int, unit_id string, context array<string>").repartition(5)
    need = {}
    for u in ids:
        need[u] = {u}.union(*(need[c] for c in context[u]))
    want = sorted([(h, u, n) for h in (1, 2) for u in ids for n in need[u]] + [(3, "p", "p")] * 2)
    assert sorted(map(tuple, spans.closure(df).collect())) == want


def test_headings_are_read_once(spark):
    """A heading read again wherever it is used made the plan, and its code, many times as large."""
    df = spark.createDataFrame([("- **Decision** : x",), ("Todo：y\n",), ("**Must:**",), (None,)], "t string")
    out = df.withColumn("h", classify.text_label(F.col("t")))
    assert [tuple(r.h) for r in out.collect()] == [("decisions", "x"), ("pending_work", "y"), (None, None), (None, None)]
    assert _plan(out).count("regexp_replace") == 1 and _plan(out).count("rlike") + _plan(out).count("RLIKE") <= 2


def test_blanks_are_stripped_as_python_does(spark):
    blanks = [c for c in map(chr, range(0x10000)) if c.isspace()]
    texts = [a + x + b for a in ("", *blanks) for b in ("", " \n", "　") for x in ("", "a", "é \n🙂", "a b")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def _messages(spark, n=3):
    rows = spark.range(n).selectExpr("id as h", "'Decision: x\nTODO: y' as t")
    m = text_messages(rows, F.col("h"), F.lit(0), F.lit("user"), F.col("t"))
    return frames(spark, rows.selectExpr("h as handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json"), m)


def test_messages_are_normalized_once(spark):
    f, told = normalize.normalize_frames(_messages(spark))
    for df in (f.messages, told):
        assert "ArrowEvalPython" not in _plan(df) and "regexp" not in _plan(df).lower()
    assert sorted((r.section, r.content) for r in f.messages.collect()) == sorted([("decisions", "x"), ("pending_work", "y")] * 3)


def test_histories_are_scanned_once(spark):
    """What a chat graph's scan finds is read from a table by all that follows."""
    items = spark.createDataFrame([(1, 0, '{"type":"ai","content":"Decision: a"}'), (2, 0, '{"type":"tool","tool_call_id":"c","content":"x"}')], "handoff_id bigint, pos bigint, item string")
    heads = items.selectExpr("handoff_id", "'s' as sender", "'r' as receiver", "'{}' as metadata_json")
    out, _ = history.compile_graph(spark, heads, items, Contract("g", ("decisions",), (), 400))
    assert [r.handoff_id for r in out.packets.collect()] == [1]
    assert "get_json_object(item" not in _plan(out.budget) and "get_json_object(item" not in _plan(out.frames.denials)
    assert [(r.handoff_id, r.code) for r in out.frames.denials.collect()] == [(2, "handoff_integrity")]


def test_a_selection_is_fitted_in_one_stream(spark):
    """A group of its own for each handoff cost more than its fit; the request is read from a table by its selector."""
    priced = spark.createDataFrame([(h, f"m0.{i}", "m", 0, i, [], 10, 5 + i, 0) for h in (1, 2) for i in range(3)], "handoff_id bigint, unit_id string, origin string, idx int, part int, context array<string>, head bigint, piece bigint, gap bigint")
    plan = spark.createDataFrame([(1, 0, "m0.0", "evidence", True), (1, 1, "m0.2", "evidence", False), (2, 0, "m0.1", "evidence", True)], "handoff_id bigint, rank int, unit_id string, section string, must boolean")
    heads = spark.createDataFrame([(1, 10), (2, 90)], "handoff_id bigint, base bigint")
    out = model.fit_units(priced, plan, heads, 60)
    assert "CoGroup" not in _plan(out)
    got = sorted((r.handoff_id, r.place, r.unit_id, r.state, r.total) for r in out.collect())
    assert got == [(1, 0, "m0.0", "kept", 43), (1, 1, "m0.2", "omitted", 43), (2, 0, None, "over", 124)]

    asked = []

    def selector(request):
        asked.append(_plan(request))
        first = request.where("part = 0").select("handoff_id", F.lit(0).alias("rank"), "unit_id", F.lit("decisions").alias("section"), F.lit(True).alias("essential"))
        return first, first.select("handoff_id", F.lit(0).alias("need"), F.array("unit_id").alias("unit_ids"))

    out = model.compile_selected(_messages(spark), Contract("g", ("decisions",), (), 400, ("n",)), selector)
    assert out.compiled.packets.count() == 3 and "MapInArrow" not in asked[0] and "Join" not in asked[0]


def test_plain_lines_are_tiled_without_the_pattern(spark):
    r = random.Random(9)
    texts = ["", "\n", "a", "a\n", "\n\na", None] + ["".join(r.choices(["a b", "\n", "\n", " ", "é", "``", "~", "`" * 3, "\r"], k=r.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.tiles(F.col("t")).alias("x"), F.regexp_extract_all("t", F.lit(spans.TILE), F.lit(0)).alias("y"))
    assert all(row.x == row.y for row in df.collect()) and "split" in _plan(df)
