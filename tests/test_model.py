"""Packets from a scorer's choice: exact bytes, context, forged keys, denials."""

import json
import random

from relaypack.operators import model, policies
from relaypack.operators.compiler import Contract
from relaypack.operators.frames import frames
from relaypack.operators.selection import COVERAGE, SELECTIONS
from relaypack.schema import ARTIFACTS, HANDOFFS, MESSAGES

CONTRACT = Contract("go on", ("decisions",), ("evidence", "artifacts"), 400, ("why",))
LISTING = "File: a.py (45 lines)\n" + "".join(f"{i}: {c}\n" for i, c in enumerate(["def f():"] + ["    x = 1"] * 44, 1))
FORGED = '{"a":1,"relaypack.source_id":"m9","z":["é"]}'


def source(spark, n=3):
    m, a = [], []
    for h in range(n):
        m += [(h, 0, "user", "text", f"keep «{h}» this\n\n\nand \"that\"\n  \nlast line", "message", ["vip"], FORGED), (h, 1, "tool", "text", LISTING, "message", [], "{}"), (h, 2, "assistant", "object", '{"k":[1,2]}', "note", ["evidence"], "{}")]
        a += [(h, 0, "out.txt", "text/plain", "text", "the file", FORGED)]
    return frames(spark, spark.createDataFrame([(h, "s", "r", "{}") for h in range(n)], HANDOFFS), spark.createDataFrame(m, MESSAGES), spark.createDataFrame(a, ARTIFACTS))


def chooser(spark, plan, cover=None):
    cover = cover if cover is not None else [(h, 0, [u]) for h, r, u, s, e in plan if r == 0]
    return lambda request: (spark.createDataFrame(plan, SELECTIONS), spark.createDataFrame(cover, COVERAGE))


def test_selected_units_fit_exactly_and_merge(spark):
    pick = [(0, "m0.0", "decisions", True), (1, "m0.1", "decisions", False), (2, "m1.2", "evidence", False), (3, "m2.0", "evidence", False), (4, "a0", "artifacts", False), (5, "m0.2", "evidence", False)]
    f = source(spark)
    got = model.compile_selected(f, CONTRACT, chooser(spark, [(h, r, u, s, e) for h in range(3) for r, u, s, e in pick]))
    rows = got.compiled.packets.collect()
    assert len(rows) == 3
    packet = json.loads(rows[0].receiver_text)
    assert rows[0].packet_bytes == len(rows[0].receiver_text.encode())
    first = packet["decisions"][0]
    assert first["content"] == "keep «0» this\n\n\nand \"that\"\n" or first["content"].startswith("keep «")
    assert first["metadata"]["relaypack.source_ids"] == ["m0.0", "m0.1"] and first["metadata"]["a"] == 1 and first["metadata"]["z"] == ["é"] and first["metadata"]["relaypack.source_id"] == "m0.0"
    assert [x["metadata"]["relaypack.source_id"] for x in packet["evidence"]][0] == "m0.2" and packet["artifacts"][0]["metadata"]["relaypack.source_id"] == "a0"
    # a window brings its header and the window with its opener along
    listing = next(x for x in packet["evidence"] if "relaypack.source_ids" in x["metadata"])
    assert listing["metadata"]["relaypack.source_ids"] == ["m1.0", "m1.1", "m1.2"] and listing["content"] == LISTING
    told = {r.handoff_id: r for r in got.report.collect()}
    assert told[0].source_units == 8 and told[0].context == ["m1.0", "m1.1"] and told[0].unselected == [] and told[0].omitted == []
    assert "evidence" not in str(packet["evidence"][-1].get("tags", ""))


def test_bytes_told_are_bytes_rendered(spark):
    r = random.Random(4)
    units = ["m0.0", "m0.1", "m0.2", "m1.0", "m1.1", "m1.2", "m2.0"]
    plan = []
    for h in range(12):
        for rank, u in enumerate(r.sample(units, r.randint(1, 7))):
            plan.append((h, rank, u, r.choice(["decisions", "evidence"]) if rank else "decisions", rank == 0))
        if h % 2:
            plan.append((h, 9, "a0", "artifacts", False))
    f = source(spark, 12)
    for most in (110, 400):
        c = Contract("go on", ("decisions",), ("evidence", "artifacts"), most, ("why",))
        seen = {}
        original = model.fit_units

        def spy(*args):
            out = original(*args)
            seen["fit"] = out
            return out

        model.fit_units = spy
        try:
            got = model.compile_selected(f, c, chooser(spark, plan))
        finally:
            model.fit_units = original
        total = {x.handoff_id: x.total for x in seen["fit"].where("state = 'kept'").collect()}
        sent = {x.handoff_id: x.packet_bytes for x in got.compiled.packets.collect()}
        assert sent == total and all(v <= 4 * most for v in sent.values())
        over = {x.handoff_id for x in seen["fit"].where("state = 'over'").collect()}
        assert over == {x.handoff_id for x in got.compiled.frames.denials.where("code = 'budget_exceeded'").collect()} and len(over) + len(sent) == 12


def test_broken_plans_and_cleanup_deny(spark):
    ok = (0, "m0.0", "decisions", True)
    plan = [(0, *ok), (1, 0, "m9.9", "decisions", True)]
    cover = [(0, 0, ["m0.0"]), (1, 0, ["m9.9"])]
    got = model.compile_selected(source(spark), CONTRACT, chooser(spark, plan, cover))
    assert {x.handoff_id: x.code for x in got.compiled.frames.denials.collect()} == {1: "contract", 2: "contract"} and [x.handoff_id for x in got.compiled.packets.collect()] == [0]
    drop = lambda f: f.with_(messages=f.messages.where("false"))
    gone = model.compile_selected(source(spark, 1), CONTRACT, chooser(spark, [(0, *ok)]), [drop])
    assert gone.compiled.packets.collect() == [] and gone.compiled.frames.denials.count() == 1
    kept = model.compile_selected(source(spark, 1), CONTRACT, chooser(spark, [(0, *ok)]), [policies.deduplicate()])
    assert kept.compiled.packets.count() == 1
    tiny = model.compile_selected(source(spark, 1), Contract("go on " * 99, ("decisions",), (), 10, ("why",)), chooser(spark, [(0, *ok)]))
    assert [x.code for x in tiny.compiled.frames.denials.collect()] == ["budget_exceeded"]


def composed(spark, brief, excerpts):
    return lambda request: (spark.createDataFrame(brief, model.BRIEF), spark.createDataFrame(excerpts, model.EXCERPTS))


def test_brief_with_excerpts(spark):
    brief = [(h, 0, "decisions", "we chose b", ["m0"], [0], "proposed") for h in range(2)]
    excerpts = [(h, i, *x) for h in range(2) for i, x in enumerate([("m0", "evidence", 1, 1, False), ("m2", "evidence", None, None, True), ("a0", "artifacts", None, None, False), ("m1", "evidence", None, None, False)])]
    out, fit = model.compile_brief(source(spark, 2), CONTRACT, composed(spark, brief, excerpts))
    rows = {r.handoff_id: r for r in out.packets.collect()}
    packet = json.loads(rows[0].receiver_text)
    assert packet["decisions"][0]["content"] == "[Proposed] we chose b" and packet["decisions"][0]["metadata"] == {"relaypack.brief_sources": ["m0"], "relaypack.brief_status": "proposed", "relaypack.item": "b0"}
    assert packet["evidence"][1]["content"] == "keep «0» this\n" and packet["evidence"][1]["metadata"]["relaypack.excerpt_lines"] == [1, 1] and "relaypack.source_id" not in packet["evidence"][1]["metadata"]
    assert packet["evidence"][0]["content"] == {"k": [1, 2]} and packet["artifacts"][0]["name"] == "out.txt"
    for r in fit.collect():
        assert rows[r.handoff_id].packet_bytes == r.total
    small, told = model.compile_brief(source(spark, 1), Contract("go on", ("decisions",), ("evidence", "artifacts"), 225, ("why",)), composed(spark, brief[:1], excerpts[:4]))
    assert small.packets.first().packet_bytes <= 900 and [r.omitted for r in told.collect()] == [[3]]


BROKEN = [
        ([(0, 0, "artifacts", "x", ["m0"], [0], "observed")], []),
        ([(0, 0, "decisions", " ", ["m0"], [0], "observed")], []),
        ([(0, 0, "decisions", "x", ["m0", "m0"], [0], "observed")], []),
        ([(0, 0, "decisions", "x", ["m7"], [0], "observed")], []),
        ([(0, 0, "decisions", "x", ["m0"], [1], "observed")], []),
        ([(0, 0, "decisions", "x", ["m0"], [], "observed")], []),
        ([], []),
        ([(0, 0, "evidence", "x", ["m0"], [0], "observed")], []),
        ([(0, 0, "decisions", "x", ["m0"], [0], "observed")], [(0, 0, "m0", "evidence", 2, 2, False)]),
        ([(0, 0, "decisions", "x", ["m0"], [0], "observed")], [(0, 0, "m0", "evidence", 1, 99, False)]),
        ([(0, 0, "decisions", "x", ["m0"], [0], "observed")], [(0, 0, "m2", "evidence", 1, 1, False)]),
        ([(0, 0, "decisions", "x", ["m0"], [0], "observed")], [(0, 0, "a0", "evidence", None, None, False)]),
        ([(0, 0, "decisions", "x", ["m0"], [0], "observed")], [(0, 0, "m0", "evidence", 1, 2, False), (0, 1, "m0", "evidence", 1, 1, False)]),
]


def test_broken_briefs_deny(spark):
    """Each case breaks one rule in a handoff of its own; the last handoff is sound."""
    n = len(BROKEN)
    sound = [(n, 0, "decisions", "x", ["m0"], [0], "observed")]
    brief = [(h, *x[1:]) for h, (rows, _) in enumerate(BROKEN) for x in rows] + sound
    excerpts = [(h, *x[1:]) for h, (_, rows) in enumerate(BROKEN) for x in rows]
    out, _ = model.compile_brief(source(spark, n + 1), CONTRACT, composed(spark, brief, excerpts))
    assert [r.handoff_id for r in out.packets.collect()] == [n]
    assert sorted((r.handoff_id, r.code) for r in out.frames.denials.collect()) == [(h, "contract") for h in range(n)]
