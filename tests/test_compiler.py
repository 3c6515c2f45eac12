import json
import random

import pytest
from test_policies import envelope, make, message

from relaypack.operators import compiler, normalize, packets, selection, spans, state, tools
from relaypack.operators.fit import fit, fit_stream
from relaypack.operators.redact import redact
from relaypack.schema import SECTIONS

ITEMS = "handoff_id bigint, ord int, pos bigint, bytes bigint"


def greedy(items, used, limit):
    kept, sec = [], None
    for o, p, b in sorted(items):
        cost = b + (sec == o)
        if used + cost <= limit:
            used, sec = used + cost, o
            kept.append(p)
    return kept


def test_fits_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(h, r.randrange(3), p, r.randint(1, 60)) for h in range(60) for p in range(r.randint(1, 25))]
    start = spark.createDataFrame([(h, r.randint(0, 40), 200) for h in range(60)], "handoff_id bigint, used bigint, max_bytes bigint").cache()
    used = {x.handoff_id: x.used for x in start.collect()}
    want = sorted((h, p) for h in range(60) for p in greedy([x[1:] for x in rows if x[0] == h], used[h], 200))
    df = spark.createDataFrame(rows, ITEMS)
    for how in (fit, fit_stream):
        assert sorted((x.handoff_id, x.pos) for x in how(df, start).where("kept").collect()) == want


def test_long_history_is_fitted_fast(spark):
    n = 10_000
    df = spark.range(n).selectExpr("1L as handoff_id", "1 as ord", "id as pos", "20 + id % 7 as bytes")
    start = spark.createDataFrame([(1, 0, 10**6)], "handoff_id bigint, used bigint, max_bytes bigint")
    assert fit(df, start).where("kept").count() == fit_stream(df, start).where("kept").count() == n


# ---- packets


def item(m):
    out = {"content": m["content"]}
    for k, d in (("kind", "message"), ("metadata", {}), ("role", "user"), ("tags", [])):
        if m[k] != d:
            out[k] = m[k]
    return out


def render(sender, receiver, goal, sections):
    return json.dumps({**{s: sections.get(s, []) for s in SECTIONS}, "goal": goal, "receiver": receiver, "sender": sender}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def slow_compile(rows, contract):
    """By rendering the whole packet for each candidate."""
    by = {}
    for r in rows:
        found = [s for s in SECTIONS if s == r[5] or s in r[6]]
        if found:
            by.setdefault(found[0], []).append(item(envelope([r])["messages"][0]))
    if any(s not in by for s in contract.required):
        return None
    kept = {s: list(by[s]) for s in contract.required}
    fits = lambda k: len(render("sender", "receiver", contract.goal, k).encode()) <= 4 * contract.max_tokens
    if not fits(kept):
        return None
    for s in contract.preferred:
        for x in by.get(s, []):
            more = {**kept, s: [*kept.get(s, []), x]}
            if fits(more):
                kept = more
    return render("sender", "receiver", contract.goal, kept)


def test_packets_equal_slow_rendering(spark):
    r = random.Random(9)
    kinds = ["decisions", "evidence", "pending_work", "constraints", "message"]
    rows = [message(h, i, "é\n\"" * r.randint(0, 5) + "x" * r.randint(0, 120), r.choice(["user", "assistant"]), r.choice(kinds), ["z", "a"] if r.random() < 0.2 else []) for h in range(30) for i in range(r.randint(1, 14))]
    contract = compiler.Contract("Do it — now", ("decisions",), ("pending_work", "evidence"), 150)
    out = compiler.compile_handoff(make(spark, rows, nested=False), contract)
    got = {p.handoff_id: p for p in out.packets.collect()}
    want = {h: slow_compile([x for x in rows if x[0] == h], contract) for h in range(30)}
    assert {h: p.receiver_text for h, p in got.items()} == {h: t for h, t in want.items() if t}
    assert {d.handoff_id for d in out.frames.denials.collect()} == {h for h, t in want.items() if t is None}
    assert all(p.packet_bytes == len(want[h].encode()) for h, p in got.items())
    assert all(b.packet_bytes == len(want[b.handoff_id].encode()) for b in out.budget.collect())


def test_skip_then_keep_smaller(spark):
    base = len(render("sender", "receiver", "g", {"constraints": [{"content": "r", "kind": "constraints"}]}))
    small = len(json.dumps({"content": "tiny", "kind": "evidence"}, separators=(",", ":")))
    tokens = -(-(base + small) // 4)
    rows = [message(1, 0, "r", kind="constraints"), message(1, 1, "x" * 500, kind="evidence"), message(1, 2, "tiny", kind="evidence")]
    out = compiler.compile_handoff(make(spark, rows), compiler.Contract("g", ("constraints",), ("evidence",), tokens)).budget.first()
    assert out.omitted_count == 1 and out.omitted_after == {"evidence": 1} and out.remaining_tokens == 0


def test_second_fit_after_redaction(spark):
    """Redaction makes rows longer, so the second fit drops what the first kept."""
    rows = [message(1, 0, "r", kind="constraints")] + [message(1, 1 + i, f"a{i}@b.io", kind="evidence") for i in range(10)]
    contract = compiler.Contract("g", ("constraints",), ("evidence",), 150)
    plain = compiler.compile_handoff(make(spark, rows), contract).budget.first()
    out = compiler.compile_handoff(make(spark, rows), contract, [redact(["email"])])
    b = out.budget.first()
    assert b.packet_tokens <= 150 and b.omitted_count > plain.omitted_count and "b.io" not in out.packets.first().receiver_text


def test_missing_and_double_sections_deny(spark):
    rows = [message(1, 0, "a", kind="evidence"), message(2, 0, "b", kind="decisions", tags=["evidence"]), message(3, 0, "x" * 900, kind="decisions")]
    f = make(spark, rows)
    contract = compiler.Contract("g", ("decisions",), ("evidence",), 120)
    out = compiler.compile_handoff(f, contract)
    assert sorted((d.handoff_id, d.code) for d in out.frames.denials.collect()) == [(1, "contract"), (2, "contract"), (3, "budget_exceeded")]
    miss = compiler.missing_required(f.with_(messages=compiler.classify(f.messages)), contract).where("handoff_id = 1").first()
    assert miss.missing == ["decisions"] and miss.section_counts == {"evidence": 1}
    for bad in ({"goal": " "}, {"required": ("x",)}, {"required": ("decisions",), "preferred": ("decisions",)}, {"max_tokens": 0}, {"needs": ("a", "a ")}):
        with pytest.raises(ValueError):
            compiler.Contract(**{"goal": "g", "required": ("evidence",), **bad})


def test_packets_are_read_back(spark):
    rows = [message(1, 0, {"b": [1], "a": "x"}, kind="decisions"), message(1, 1, "t", kind="decisions"), message(1, 2, "e", kind="evidence")]
    out = compiler.compile_handoff(make(spark, rows), compiler.Contract("g", ("decisions",), ("evidence",), 500))
    back = packets.decode(out.packets).orderBy("section", "pos").collect()
    assert [(b.section, b.pos, json.loads(b.item)["content"]) for b in back] == [("decisions", 0, {"a": "x", "b": [1]}), ("decisions", 1, "t"), ("evidence", 0, "e")]
    texts = spark.createDataFrame([(1, "plain"), (2, "{}"), (3, '{"goal":1}'), (4, out.packets.first().receiver_text)], "handoff_id bigint, receiver_text string")
    assert [r.handoff_id for r in texts.where(packets.is_packet(texts.receiver_text)).collect()] == [4]
    heads = spark.createDataFrame([(4, "someone else")], "handoff_id bigint, sender string")
    assert packets.wrong_receiver(texts, heads).count() == 1
    flat = packets.flatten(out.frames.live().withColumn("goal", out.frames.handoffs.sender), out.items.select("handoff_id", "section", "pos", "item")).orderBy("msg_idx").collect()
    assert [(r.kind, r.msg_idx) for r in flat] == [("decisions", 0), ("decisions", 1), ("evidence", 2)]


# ---- state


def replay(rows):
    """(scope, section, key) events one after the other, with what completes removing what is pending."""
    last = {}
    for i, (scope, section, key) in enumerate(rows):
        last[scope, section, key] = i
        if section == "completed_work":
            last.pop((scope, "pending_work", key), None)
    return set(last.values())


def test_state_equals_replay(spark):
    r = random.Random(1)
    sections = ["pending_work", "completed_work", "decisions"]
    every = [(h, i, r.choice([None, "t1"]), r.choice(sections), r.choice("ab")) for h in range(150) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame(every, "h int, i int, scope string, section string, key string")
    got = {(x.h, x.i) for x in state.last_writer(df, ["h", "scope"], "section", "key", "i").where("alive").collect()}
    want = {(h, i) for h in range(150) for i in replay([x[2:] for x in every if x[0] == h])}
    assert got == want


def test_prepare(spark):
    m = lambda i, t, kind="message", key=None, task=None, tags=(): message(1, i, t, kind=kind, tags=tags, metadata=json.dumps({k: v for k, v in (("state_key", key), ("task_id", task)) if v is not None}, separators=(",", ":")))
    rows = [m(0, "old", "decisions", "k"), m(1, "free one", "decisions"), m(2, "new", "decisions", "k"), m(3, "free two", "decisions"), m(4, "by tag", key="k2", tags=["decisions"]), m(5, "newer by kind", "decisions", "k2"), m(6, "free one", "decisions"), m(7, "other task", task="t9"), m(8, "mine", task="t1"), m(9, "no section", key="k")]
    f = make(spark, rows)
    assert [r.content for r in state.prepare(f, "t1").messages.orderBy("msg_idx").collect()] == ["free one", "new", "free two", "newer by kind", "mine", "no section"]
    bad = make(spark, [message(1, 0, "x", metadata='{"task_id":7}'), message(2, 0, "x", metadata='{"state_key":" "}'), message(3, 0, "fine", metadata='{"task_id":"t"}'), message(4, 0, "two", kind="decisions", tags=["evidence"])])
    out = state.prepare(bad, None)
    assert sorted((d.handoff_id, d.code) for d in out.denials.collect()) == [(1, "validation"), (2, "validation"), (4, "contract")]


# ---- normalization


def sections_of(spark, *rows):
    f, told = normalize.normalize_frames(make(spark, [message(1, i, *r) if isinstance(r, tuple) else message(1, i, r) for i, r in enumerate(rows)]))
    return [(r.section, r.content) for r in f.messages.orderBy("msg_idx").collect()], told.first(), f


def test_rules(spark):
    got, told, _ = sections_of(spark, "Decision: use it", ("out", "tool"), {"todo": "x"}, ("hinted", "user", "message", (), '{"handoff_section":"evidence"}'), "hello", ("kept: Decision: no", "user", "decisions"), "## **TODO:** tests", "Decision:")
    assert got[:4] == [("decisions", "use it"), ("tool_results", "out"), ("pending_work", '{"todo":"x"}'), ("evidence", "hinted")]
    assert got[4:8] == [(None, "hello"), ("decisions", "kept: Decision: no"), ("pending_work", "tests"), (None, "Decision:")]
    assert told.unclassified_indices == [4, 7] and told.rule_counts["explicit_kind_or_tag"] == 1 and told.rule_counts["text_prefix"] == 2


def test_conflicts_deny(spark):
    rows = [message(1, 0, "Evidence: x", metadata='{"handoff_section":"decisions"}'), message(2, 0, "a", kind="decisions", tags=["evidence"]), message(3, 0, "b", metadata='{"receiver_section":"artifacts"}'), message(4, 0, "Decision: fine"), message(5, 0, "x", kind="artifacts")]
    f, _ = normalize.normalize_frames(make(spark, rows))
    assert {d.handoff_id for d in f.denials.collect()} == {1, 2, 3, 5}


def test_long_note_with_fence(spark):
    note = "Constraint: offline only\n\n```python\n# Decision: not a heading\n~~~\n```\nmore\n待办： 测试\nDone: 1\n"
    got, told, _ = sections_of(spark, note, "preamble\nDecision: X\nTODO: Y")
    assert got == [("constraints", "offline only\n\n```python\n# Decision: not a heading\n~~~\n```\nmore"), ("pending_work", "测试"), ("completed_work", "1"), (None, "preamble"), ("decisions", "X"), ("pending_work", "Y")]
    assert told.classified == 2 and told.unclassified_indices == [1]


def test_history_counts_source_tokens_before_splitting(spark):
    rows = [message(1, 0, "intro\nDecision: X\nTODO: Y"), message(1, 1, "chat")]
    out, told = compiler.compile_history(make(spark, rows), compiler.Contract("g", ("decisions",), ("pending_work",), 400))
    from test_policies import wide_tokens

    assert out.budget.first().source_tokens == wide_tokens(envelope(rows))
    assert json.loads(out.packets.first().receiver_text)["pending_work"] == [{"content": "Y", "kind": "pending_work"}]


# ---- tools


def test_tool_errors(spark):
    rows = [(1, 0, "a", True), (1, 1, None, None), (1, 2, "a", False), (2, 0, "a", True), (2, 1, "a", False), (2, 2, "b", None)]
    df = spark.createDataFrame(rows, "handoff_id bigint, pos int, call_id string, is_call boolean")
    assert tools.validate(df).collect() == []
    assert [tuple(r) for r in tools.validate(df, strict_order=True).collect()] == [(1, "message_while_pending")]
    assert {(r.call_pos, r.output_pos) for r in tools.pairs(df.where("is_call is not null")).collect()} == {(0, 2), (0, 1)}
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "handoff_id bigint, descriptor string")
    assert tools.same_multiset(a, a).count() == 0 and [r[0] for r in tools.same_multiset(a, a.distinct()).collect()] == [1]


# ---- spans and plans


def _spans_by_hand(text):
    """Nonblank lines; a fence opens a span that ends after the next line that begins with it."""
    import re

    lines, out, at = text.splitlines(keepends=True), [], 0
    while lines:
        n = 1
        if m := re.match(r"[ \t]*(`{3,}|~{3,})", lines[0]):
            closing = [i for i, x in enumerate(lines[1:], 1) if x.lstrip(" \t").startswith(m[1])]
            n = closing[0] + 1 if closing else len(lines)
        piece = "".join(lines[:n])
        if piece.strip():
            out.append((at, at + len(piece)))
        at, lines = at + len(piece), lines[n:]
    return out


def test_text_spans_equal_the_rule(spark):
    import random

    r = random.Random(3)
    texts = ["~~~~\nopen\n~~~\n", "", "\n\n", "a\r\n\r\nb\rc\x0bd e", "x\n```py\ncode\n\n  ```\nafter", "  ````\n```\n````` end\nz", "é🙂\n🙂"]
    texts += ["".join(r.choices(["a b", "```", "~~~", "````", "  ", "\n", "\n", "\r\n", "\r", "\x85", "\t", "é"], k=r.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(texts)], "handoff_id bigint, msg_idx int, content string")
    got = {}
    for row in spans.text_spans(df).select("msg_idx", "_s.*").orderBy("msg_idx", "part").collect():
        assert row.content == texts[row.msg_idx][row.start : row.end] and row.part == len(got.get(row.msg_idx, []))
        got.setdefault(row.msg_idx, []).append((row.start, row.end))
    assert got == {i: x for i, t in enumerate(texts) if (x := _spans_by_hand(t))}


def test_windows():
    body = [f"{i}: {c}" for i, c in enumerate(["class A:"] + ["    def f(self):"] + ["        y()"] * 88, 5)]
    text = "File: a/b.py (90 lines)\n" + "\n".join(body)
    w = spans.code_windows(text)
    assert "".join(text[s:e] for s, e, _ in w) == text and [c for *_, c in w] == [[], [0], [0, 1], [0, 1]]
    assert all(text[s:e].count("\n") <= 40 for s, e, _ in w)
    assert spans.code_windows(text.replace("7: ", "8: ", 1)) is None and spans.code_windows("no header\n1: x") is None


def test_closure_finds_cycles(spark):
    df = spark.createDataFrame([(1, "m", 0, "a", ["b"]), (1, "m", 0, "b", ["a"])], "handoff_id bigint, origin string, idx int, unit_id string, context array<string>")
    with pytest.raises(Exception, match="depend on each other"):
        spans.closure(df).collect()


def test_plan_essentials(spark):
    plan = spark.createDataFrame([(1, 1, "a", "evidence", False), (1, 2, "b", "decisions", False), (1, 3, "c", "evidence", False)], selection.SELECTIONS)
    cover = spark.createDataFrame([(1, 0, ["c"])], selection.COVERAGE)
    got = selection.essential(plan, cover, compiler.Contract("g", ("decisions",), ("evidence",), 9, ("n",)))
    assert {r.unit_id: r.must for r in got.collect()} == {"a": False, "b": True, "c": True}


def test_estimates_cover_context(spark):
    from relaypack.plans.selection_queries import _listing_frames

    u = spans.source_units(_listing_frames(spark))
    e = {r.unit_id: r for r in selection.insertion_estimates(u).collect()}
    assert e["m0.2"].estimate > e["m0.2"].own_tokens + e["m0.1"].own_tokens and len(e) == u.count()


def test_statements(spark):
    df = spark.createDataFrame([("observed", "a"), ("proposed", "b"), ("uncertain", "c")], "status string, content string")
    assert sorted(r[0] for r in df.select(selection.brief_text()).collect()) == ["[Proposed] b", "[Unverified] c", "a"]
