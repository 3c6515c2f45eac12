import json
import math
import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relaypack import schema
from relaypack.functions import tokens as tk
from relaypack.functions.patterns import DETECTORS
from relaypack.operators import policies as po
from relaypack.operators.frames import envelope_sizes, frames
from relaypack.operators.redact import pattern_chain, redact, redact_text, redact_value
from relaypack.plans.pipeline import process, reports, run_policies
from relaypack.sources.config import ConfigurationError, parse

HEAD = "handoff_id bigint, sender string, receiver string, metadata_json string"


def message(h, i, content, role="user", kind="message", tags=(), metadata="{}"):
    text = isinstance(content, str)
    return (h, i, role, "text" if text else "object" if isinstance(content, dict) else "array", content if text else json.dumps(content, ensure_ascii=False, separators=(",", ":")), kind, list(tags), metadata)


def make(spark, rows, artifacts=(), heads=None, nested=True):
    ids = sorted({r[0] for r in rows} | {a[0] for a in artifacts})
    heads = spark.createDataFrame(heads or [(h, "sender", "receiver", "{}") for h in ids], HEAD)
    return frames(spark, heads, spark.createDataFrame(list(rows), schema.MESSAGES), spark.createDataFrame(list(artifacts), schema.ARTIFACTS), nested=nested)


def contents(f):
    return [r.content for r in f.messages.orderBy("handoff_id", "msg_idx").collect()]


def envelope(rows, artifacts=(), sender="sender", receiver="receiver", metadata=None):
    load = lambda kind, c: c if kind == "text" else json.loads(c)
    return {
        "sender": sender, "receiver": receiver, "metadata": metadata or {},
        "messages": [{"role": r[2], "content": load(r[3], r[4]), "kind": r[5], "tags": sorted(r[6]), "metadata": json.loads(r[7])} for r in rows],
        "artifacts": [{"name": a[2], "media_type": a[3], "content": load(a[4], a[5]), "metadata": json.loads(a[6])} for a in artifacts],
    }


def wide_tokens(x):
    return math.ceil(len(json.dumps(x, ensure_ascii=False, sort_keys=True).encode()) / 4) + 4


ROWS = [
    message(1, 0, 'quote " back \\ tab\t nl\n é 🙂 \x0b\x1f', tags=["b", "a"]), message(1, 1, {"k, :": ["x:y", {"z": 1.5}], "a": None}, "tool", "structured", metadata='{"n":{"m":[1,2]}}'),
    message(1, 2, "", "assistant"), message(2, 0, [1, "two,"], kind="résumé"),
]
ARTIFACTS = [(1, 0, "a.txt", "text/plain", "text", "body", "{}"), (1, 1, "b.json", "application/json", "object", '{"q":"w"}', '{"v":1}')]


def test_sizes_equal_json(spark):
    f = make(spark, ROWS, ARTIFACTS)
    got = {r.handoff_id: r.tokens for r in envelope_sizes(f).collect()}
    assert got == {h: wide_tokens(envelope([r for r in ROWS if r[0] == h], [a for a in ARTIFACTS if a[0] == h])) for h in (1, 2)}
    wide = [r[0] for r in f.messages.orderBy("handoff_id", "msg_idx").select(tk.message_bytes(wide=True)).collect()]
    assert wide == [len(json.dumps(m, ensure_ascii=False, sort_keys=True).encode()) for m in envelope(ROWS)["messages"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_literals_equal_json(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] or [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(tk.literal(F.col("t")), tk.literal_bytes(F.col("t")), tk.text_tokens(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(json.dumps(t, ensure_ascii=False), len(json.dumps(t, ensure_ascii=False).encode()), math.ceil(len(t.encode()) / 4)) for t in texts]


def test_control_characters(spark):
    t = "".join(map(chr, range(32))) + "\\u001F \\\\u000B \x7f"
    assert spark.createDataFrame([(t,)], "t string").select(tk.literal(F.col("t"))).first()[0] == json.dumps(t, ensure_ascii=False)


# ---- redaction


def test_nested_redaction_counts(spark):
    f = redact()(make(spark, [message(1, 0, {"owner": "me@example.org", "credentials": ["sk-abcdefgh1234"]})]))
    assert contents(f) == ['{"owner":"[REDACTED:email]","credentials":["[REDACTED:api_key]"]}']
    assert f.events.collect()[0]["count"] == 2


def test_colliding_keys_get_numbers():
    chain = [("[REDACTED:email]", regex.compile(DETECTORS["email"]))]
    assert redact_value({"a@b.co": 1, "c@d.co": 2, "[REDACTED:email]__2": 3, "x": ["e@f.co"]}, chain, 1) == ({"[REDACTED:email]": 1, "[REDACTED:email]__2": 2, "[REDACTED:email]__2__2": 3, "x": ["[REDACTED:email]"]}, 3)


def test_every_public_field_is_redacted(spark):
    m = "x@y.org"
    f = make(spark, [message(1, 0, {m: m}, m, m, [m], json.dumps({"k": m}))], [(1, 0, m, m, "text", m, json.dumps({m: [m]}))], [(1, m, m, json.dumps({"o": m}))])
    out = redact(["email"])(f)
    for df in (out.messages, out.artifacts, out.handoffs):
        assert m not in json.dumps([r.asDict() for r in df.collect()])
    # message: 2 + role, kind, tag, metadata; artifact: name, media type, content, 2 in metadata; envelope: sender, receiver, metadata
    assert out.events.collect()[0]["count"] == 6 + 5 + 3


def test_limits_deny(spark):
    f = redact(max_scan_bytes=60)(make(spark, [message(1, 0, "x" * 60), message(2, 0, "short")]))
    assert [(r.handoff_id, r.code) for r in f.denials.collect()] == [(1, "redaction")] and contents(f) == ["short"]
    f = redact(max_scan_strings=6)(make(spark, [message(1, 0, "x"), message(1, 1, "y"), message(2, 0, "z")]))
    assert [r.handoff_id for r in f.denials.collect()] == [1]


def test_slow_patterns_deny_their_row_only(spark):
    rows = [message(1, 0, {"t": "a" * 40 + "!"}), message(2, 0, {"t": "fine"})]
    f = redact([], {"slow": "(a|aa)+$"}, timeout_ms=20)(make(spark, rows)) if _is_slow() else None
    if f is not None:
        assert {r.handoff_id for r in f.denials.collect()} == {1}


def _is_slow():
    try:
        regex.compile("(a|aa)+$").subn("x", "a" * 40 + "!", timeout=0.02)
        return False
    except TimeoutError:
        return True


def test_chain_order_and_checks():
    assert [n for n, _ in pattern_chain(["email", "phone"], {"phone": "x+", "z": "y"})] == ["phone", "z", "email"]
    assert dict(pattern_chain(["phone"], {"phone": "x+"}))["phone"] == DETECTORS["phone"]
    for bad in ({"custom": {"a b": "x"}}, {"custom": {"a": "x*"}}, {"detectors": ["nope"]}, {"custom": {f"n{i}": "x" for i in range(33)}}, {"custom": {"a": "x" * 1001}}):
        with pytest.raises(ValueError):
            pattern_chain(bad.get("detectors", ()), bad.get("custom"))


def test_unicode_words_as_in_python(spark):
    texts = ["é4155550137123 1", "call +1 (415) 555-0137 now", "٣٤٥٦٧٨٩٠١٢", "éalice@example.org", "mail bob@example.org.", "no"]
    chain = pattern_chain(["email", "phone"])
    text, n = redact_text(F.col("t"), chain)
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text, n).collect()]
    want = []
    for t in texts:
        k = 0
        for name, p in chain:
            t, j = regex.subn(p, f"[REDACTED:{name}]", t)
            k += j
        want.append((t, k))
    assert got == want


# ---- dedup, protection, schema, summary


def test_dedup(spark):
    rows = [message(1, 0, "first"), message(1, 1, "second"), message(1, 2, "first"), message(2, 0, "first"), message(1, 3, {"a": 1}), message(1, 4, {"a": 1}, tags=["t"]), message(1, 5, {"a": 1})]
    assert contents(po.deduplicate()(make(spark, rows))) == ["first", "second", '{"a":1}', '{"a":1}', "first"]


def test_redacted_mails_stay_two_and_equal_ones_fall_together(spark):
    f = make(spark, [message(1, 0, "a@b.org"), message(1, 1, "c@d.org"), message(1, 2, "a@b.org")])
    kept = po.deduplicate()(redact(["email"], keep_source=True)(f))
    assert contents(kept) == ["[REDACTED:email]"] * 2
    assert kept.messages.where("src_key is not null").count() == 0


def test_preserve_by_tag_key_and_category(spark):
    rows = [message(1, 0, "a", tags=["citation"]), message(1, 1, {"constraints": 1}), message(1, 2, "c", metadata='{"category":"conclusion"}'), message(1, 3, "d"), message(1, 4, {"other": 1}, metadata='{"category":["constraint"]}')]
    f = po.select(roles=["nobody"])(po.preserve()(make(spark, rows)))
    assert contents(f) == ["a", '{"constraints":1}', "c"]
    assert {(r.action, r["count"]) for r in f.events.collect()} == {("protected", 3), ("selected", 2)}


def test_schema_denies_and_counts(spark):
    rows = [message(1, 0, {"a": "x", "b": {"z": 1, "y": "q"}, "c": 1}, kind="structured"), message(2, 0, {"a": 1}, kind="structured"), message(3, 0, "text", kind="structured"), message(4, 0, "other")]
    f = po.required_fields(["b", "a"])(make(spark, rows))
    assert contents(f) == ['{"b":{"z":1,"y":"q"},"a":"x"}', "other"]
    assert sorted((r.handoff_id, r.code) for r in f.denials.collect()) == [(2, "validation"), (3, "validation")]
    diff = spark.createDataFrame([('{"a":1,"b":{"c":1,"d":2}}', '{"a":2,"b":{"c":1}}'), ("[1,2]", "[1,3,4]"), (None, "1")], "x string, y string").select(po.structural_diff("x", "y").alias("d")).select("d.*").collect()
    assert [tuple(r) for r in diff] == [(1, 1), (2, 0), (0, 0)]


def test_summary_takes_the_first_free_place_and_fits(spark):
    rows = [message(1, 0, "keep", tags=["constraint"]), message(1, 1, "one"), message(1, 2, "two"), message(2, 0, "x" * 400), message(3, 0, "keep", tags=["constraint"])]
    f = po.summarize(20)(po.preserve()(make(spark, rows)))
    got = {(r.handoff_id, r.msg_idx): (r.kind, r.content) for r in f.messages.collect()}
    assert got[1, 1] == ("summary", "[offline extract] one\ntwo") and got[1, 0][0] == "message" and (3, 0) in got
    assert math.ceil(len(got[2, 0][1]) / 4) <= 20
    denied = po.summarize(3, lambda t, n: "far too long for three tokens")(make(spark, rows))
    assert {r.handoff_id for r in denied.denials.collect()} == {1, 2, 3}


# ---- budgets


def pop(rows, limit, strategy):
    """What is left when rows go one by one."""
    rows = list(rows)
    order = [r for r in rows if not r[6]]
    if strategy == "drop_largest":
        size = lambda r: wide_tokens(envelope([r])["messages"][0])
        order.sort(key=lambda r: -size(r))
    while wide_tokens(envelope(rows)) > limit:
        if not order:
            return None
        rows.remove(order.pop(0))
    return rows


@pytest.mark.parametrize("strategy", ["drop_oldest", "drop_largest"])
def test_budget_equals_popping(spark, strategy):
    r = random.Random(5)
    rows = [message(h, i, "é" * r.randint(0, 60) + "x" * r.randint(0, 90), tags=["constraint"] if r.random() < 0.2 else []) for h in range(40) for i in range(r.randint(1, 12))]
    f = po.budget(150, strategy)(po.preserve()(make(spark, rows, nested=False)))
    want, denied = [], set()
    for h in range(40):
        left = pop([x for x in rows if x[0] == h], 150, strategy)
        want += left or []
        denied |= {h} if left is None else set()
    assert sorted((m.handoff_id, m.msg_idx) for m in f.messages.collect()) == sorted((x[0], x[1]) for x in want)
    assert {d.handoff_id for d in f.denials.collect()} == denied and denied
    over = po.budget(150, "error")(make(spark, rows, nested=False))
    assert {d.handoff_id for d in over.denials.collect()} == {h for h in range(40) if wide_tokens(envelope([x for x in rows if x[0] == h])) > 150}


# ---- pipeline, configuration, reports


def test_configuration():
    ok = parse({"version": 1, "policies": ["preserve", {"redact": {"detect": ["email"]}}, "deduplicate", {"budget": {"max_tokens": 99, "overflow": "drop_largest"}}], "rules": [{"from": "a*", "policies": [{"select": {"roles": ["user"]}}]}], "on_multiple_match": "all"})
    assert [p.name for p in ok.policies] == ["preserve", "redact", "deduplicate", "budget"] and ok.rules[0].rule_id == "rule-1" and len(ok.fingerprint) == 64
    for bad in ({"version": 2}, {"x": 1}, {"policies": ["os.system"]}, {"policies": [{"budget": {}}]}, {"policies": [{"redact": {"z": 1}}]}, {"policies": ["deduplicate", "preserve"]}, {"policies": [{"budget": {"max_tokens": 1}}, {"budget": {"max_tokens": 1}}]}, {"rules": [{}]}, {"on_unmatched": "maybe"}, {"rules": [{"id": "a", "policies": []}, {"id": "a", "policies": []}]}):
        with pytest.raises(ConfigurationError):
            parse(bad)


def test_routes_choose_policies_and_deny(spark):
    rows = [message(h, i, t) for h in (1, 2, 3, 4) for i, t in enumerate(["a", "a", "mail x@y.org"])]
    heads = [(1, "coder", "writer", "{}"), (2, "coder", "boss", "{}"), (3, "x", "writer", "{}"), (4, "both", "writer", "{}")]
    cfg = parse({"policies": ["preserve"], "rules": [{"id": "d", "from": "[cb]o*", "to": "w*", "policies": ["deduplicate"]}, {"id": "r", "from": "coder", "to": "b?ss", "policies": [{"redact": {"detect": ["email"]}}]}, {"id": "b", "from": "both", "policies": []}]})
    done, told = process(spark, make(spark, rows, heads=heads, nested=False), cfg)
    got = {r.handoff_id: r for r in told.collect()}
    assert [(got[h].status, got[h].failure_code) for h in (1, 2, 3, 4)] == [("passed", None), ("passed", None), ("denied", "unmatched_route"), ("denied", "ambiguous_route")]
    assert got[1].duplicates_removed == 1 and got[2].redactions == 1 and got[3].transmitted_tokens == 0
    assert contents(done) == ["a", "mail x@y.org", "a", "a", "mail [REDACTED:email]"]


def test_reports_hold_no_contents(spark):
    secret = "sk-verysecret123"
    f = make(spark, [message(1, 0, f"key {secret}"), message(1, 1, "x" * 300), message(2, 0, "y" * 4000)])
    done = run_policies(f, [redact(), po.budget(200)])
    out = reports(f, done).collect()
    text = repr(out)
    assert secret not in text and "xxx" not in text
    by = {r.handoff_id: r for r in out}
    assert by[1].redactions == 1 and by[2].status == "passed" and by[2].removed_messages == 1
    assert by[1].original_tokens == wide_tokens(envelope([message(1, 0, f"key {secret}"), message(1, 1, "x" * 300)]))


def test_order_is_checked(spark):
    with pytest.raises(ConfigurationError):
        run_policies(make(spark, [message(1, 0, "a")]), [po.budget(10), po.deduplicate()])
