"""Records, payloads, audit and fixtures beyond what the queries compare."""

import json

import pytest
from pyspark.sql import functions as F

from relaypack.operators import audit, counters, payloads, records
from relaypack.operators import policies as po
from relaypack.operators.redact import redact
from relaypack.sources import fixtures


def test_run_files_are_read_back_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, f"x{i}") for i in range(5)] + [("b", 0, "y")], "task_id string, idx bigint, answer string")
    records.write_runs(rows, str(tmp_path / "runs"))
    back = spark.read.json(str(tmp_path / "runs"))
    assert records.whole_runs(back).where("whole").count() == 2
    assert not records.whole_runs(back.where("kind <> 'run_completed' or task_id <> 'a'")).where("task_id = 'a'").first().whole
    files = list((tmp_path / "runs" / "task_id=a").glob("part-*.json"))
    assert len(files) == 1 and [json.loads(x)["line_no"] for x in files[0].read_text().splitlines()] == list(range(7))


def test_resumed_run_adds_nothing_twice(spark):
    plan = spark.createDataFrame([(i, c) for i in range(3) for c in "xy"], "task_id bigint, condition string")
    left = records.still_to_run(plan, plan.where("task_id < 2").unionAll(plan.where("task_id < 1")), ["task_id", "condition"])
    assert sorted(tuple(r) for r in left.collect()) == [(2, "x"), (2, "y")]


def test_actions(spark):
    good = '{"operation":"read","path":"a","query":"","old":"","new":"","note":"","start":1,"end":2}'
    cases = [(good, False, 1), (f" {good}\n{good} ", False, 2), (good.replace("read", "edit"), False, None), (good.replace("read", "edit"), True, 1), (good.replace('"start":1', '"start":true'), True, None), (good[:-1] + ',"x":1}', True, None), ("", True, None), (f"{good} trailing", True, None), (None, True, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, w boolean")
    assert [r[0] for r in df.select(F.json_array_length(records.parse_actions("t", "w"))).collect()] == [c[2] for c in cases]


def test_reports_are_written_once_and_failures_deny(spark, tmp_path):
    shape = "handoff_id bigint, status string, failure_code string, failed_policy string, transmitted_tokens bigint"
    r = spark.createDataFrame([(1, "passed", None, None, 5), (2, "denied", "x", "p", 0), (3, "passed", None, None, 7)], shape)
    path = str(tmp_path / "audit")

    def fails(row):
        if row["handoff_id"] < 3:
            raise RuntimeError("secret in a message")

    final = {x.handoff_id: x for x in audit.emit(spark, r, path, {"mail": fails}).collect()}
    assert (final[1].status, final[1].failure_code, final[1].transmitted_tokens) == ("denied", "audit_export", 0) and final[2].failure_code == "x" and final[3].status == "passed"
    assert final[1].warnings == ["reporter failed: mail"] and final[3].warnings == []
    audit.emit(spark, r, path, {})
    back = spark.read.json(path)
    assert back.count() == 3 and "secret" not in str(back.collect())


def test_fingerprints(spark):
    one = [po.preserve(), redact(["email"]), po.budget(100)]
    assert audit.fingerprint(one) == audit.fingerprint([po.preserve(), redact(["email"]), po.budget(100)])
    others = [[po.preserve(), redact(["email"]), po.budget(101)], [redact(["email"]), po.preserve(), po.budget(100)], [po.preserve(("x",)), redact(["email"]), po.budget(100)], [po.preserve(), redact(["phone"]), po.budget(100)]]
    assert len({audit.fingerprint(one), *map(audit.fingerprint, others), audit.fingerprint(one, counter="t"), audit.fingerprint(one, on_unmatched="pass")}) == 7
    hooked = po.select(roles=["user"])
    hooked.fingerprint_material = lambda: {"b": {2, 1}, "a": None}
    assert audit.policy_material(hooked)["settings"] == [["a", None], ["b", [1, 2]]]


def test_keyed_digest_is_an_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"long" * 40):
        assert spark.range(1).select(audit.keyed(F.lit("tëxt"), key)).first()[0] == hmac.new(key, "tëxt".encode(), hashlib.sha256).hexdigest()


def test_counters(spark):
    import public_tokenizers

    c = counters.tiktoken_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([("hello world <|endoftext|>",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(c.column(F.col("t"))).collect()]
    assert got[0] == c.text("hello world <|endoftext|>") > 2 and got[1:] == [0, None]
    items = spark.createDataFrame([(1, 0, i, i == 3, "word " * n) for i, n in enumerate([5, 40, 3, 2])], "handoff_id bigint, ord int, pos bigint, required boolean, item string")
    heads = spark.createDataFrame([(1, "", "")], "handoff_id bigint, before string, after string")
    kept = {r.pos: r.kept for r in counters.fit_counted(items, heads, c, 20).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: True}
    assert counters.fit_counted(items, heads, c, 1).collect() == []


def test_fixtures_and_manifests(spark, tmp_path):
    good = {"id": "f", "budget": 9, "messages": ["the key is K1", "fact A"], "secrets": ["K1"], "clean": ["fact"], "facts": ["fact A"]}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(good))
    assert fixtures.load_fixture(spark, str(path)).first().budget == 9
    for change, code in (({"budget": 0}, "bad_budget"), ({"secrets": []}, "no_secrets"), ({"facts": ["B"]}, "absent_probe"), ({"clean": ["K1"]}, "clean_is_secret"), ({"secrets": ["K1", "K1"]}, "repeated_probe")):
        path.write_text(json.dumps(good | change))
        with pytest.raises(ValueError, match=code):
            fixtures.load_fixture(spark, str(path))
    manifest = {"version": "1", "tasks": [{"id": "a", "category": "x", "path": "a/t.json"}, {"id": "b", "category": "x", "path": "b/t.json"}]}
    path.write_text(json.dumps(manifest))
    assert fixtures.load_manifest(spark, str(path)).count() == 2
    manifest["tasks"][1]["path"] = "../t.json"
    path.write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="path_outside"):
        fixtures.load_manifest(spark, str(path))


def test_forged_metadata_goes(spark):
    df = spark.createDataFrame([('{"relaypack.item":"x"}',), ("{}",), ('{"a": {"relaypack.item": 1}}',)], "m string")
    assert [r[0] for r in df.select(payloads.stripped(F.col("m"))).collect()] == ["{}", "{}", '{"a": {"relaypack.item": 1}}']


def test_pluggable_normalizer(spark, sf_dir):
    from relaypack.operators import compiler
    from relaypack.plans.common import conversation_frames

    def mine(f):
        return f.with_(messages=f.messages.withColumn("section", F.lit("evidence"))), f.messages.groupBy("handoff_id").count()

    out, told = compiler.compile_history(conversation_frames(spark, sf_dir), compiler.Contract("g", ("evidence",), (), 100_000), normalizer=mine)
    assert out.packets.count() == told.count() > 0
