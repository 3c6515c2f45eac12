import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_policies import make, message

from relaypack.functions.text import bare_lines, glob_regex, lines, normal_key, snake_code, strip
from relaypack.operators import evaluation as ev
from relaypack.operators.redact import redact
from relaypack.plans.pipeline import reports, run_policies
from relaypack.sources import scans, sinks
from relaypack.streaming import state as stream


def items(spark, *xs):
    return spark.createDataFrame([(1, i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(xs)], "handoff_id bigint, msg_idx int, item string")


def test_message_items(spark):
    got = scans.message_items(items(spark, "text é", {"content": "c", "role": "tool", "tags": ["b", "a", "b"], "metadata": {"k": [1]}}, {"z": 1, "a": {"y": 2}}, {"content": {"b": 1, "a": "x"}, "kind": "k"}, {"content": "x", "protected": True}, {"content": "x", "nope": 1}, [1], {"content": 5})).orderBy("msg_idx").collect()
    assert [(r.role, r.content_type, r.kind, r.failure) for r in got[:4]] == [("user", "text", "message", None), ("tool", "text", "message", None), ("user", "object", "structured", None), ("user", "object", "k", None)]
    assert got[0].content == "text é" and got[1].content == "c" and got[1].tags == ["a", "b"] and got[1].metadata_json == '{"k":[1]}'
    assert got[2].content == '{"z":1,"a":{"y":2}}' and json.loads(got[3].content) == {"a": "x", "b": 1}
    assert [r.failure for r in got[4:]] == ["reserved_field", "validation", "validation", "validation"]


def test_envelopes(spark, tmp_path):
    rows = [{"handoff_id": 7, "sender": "s", "receiver": "r", "messages": ["hi", {"content": {"a": 1}, "role": "tool"}], "artifacts": [{"name": "n", "content": "body"}, {"name": "o", "content": [1], "media_type": "x/y", "metadata": {"v": 1}}]}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    heads, m, a = scans.envelopes(spark, str(tmp_path / "e.jsonl"))
    assert heads.first().metadata_json == "{}" and [(r.content, r.role) for r in m.orderBy("msg_idx").collect()] == [("hi", "user"), ('{"a":1}', "tool")]
    assert [(r.content_type, r.content, r.media_type) for r in a.orderBy("art_idx").collect()] == [("text", "body", "text/plain"), ("array", "[1]", "x/y")]


def test_snapshots(spark):
    j = json.dumps
    call, out = j({"type": "function_call", "call_id": "c1", "name": "f", "arguments": "{}"}), j({"type": "function_call_output", "call_id": "c1", "output": "42"})
    rows = [
        (1, [j("hello"), j({"role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}]})], [call], None, [out, j({"type": "handoff_call"}), j({"type": "reasoning"})]),
        (2, [], [], [call], [out]),
        (3, [j({"type": "image"})], [], None, []),
        (4, [], [], [j({"role": "user", "content": [{"type": "input_image"}]})], []),
    ]
    df = spark.createDataFrame(rows, "handoff_id bigint, history array<string>, pre_items array<string>, input_items array<string>, new_items array<string>")
    m, bad = scans.snapshot_messages(scans.snapshot_items(df))
    assert {(r.handoff_id, r.code) for r in bad.collect()} == {(2, "handoff_integrity"), (3, "unsupported_adapter_mode"), (4, "unsupported_adapter_mode")}
    got = m.orderBy("msg_idx").collect()
    assert [(r.role, r.content) for r in got[:2]] == [("user", "hello"), ("assistant", "a\nb")]
    assert json.loads(got[2].content) == {"tool_result": {"call_id": "c1", "name": "f", "arguments": "{}", "output": "42"}} and got[2].kind == "tool_results"


def test_graph_state(spark):
    j = json.dumps
    ai = {"type": "ai", "content": "", "tool_calls": [{"id": "c", "name": "f", "args": {"x": 1}}]}
    rows = [(1, 0, j({"type": "human", "content": "q"})), (1, 1, j(ai)), (1, 2, j({"type": "tool", "tool_call_id": "c", "content": "r"})), (1, 3, j({"type": "ai", "content": "done"})), (2, 0, j(ai)), (2, 1, j({"type": "human", "content": "?"})), (3, 0, j({"type": "tool", "tool_call_id": "zz", "content": "r"}))]
    m, bad = scans.graph_messages(spark.createDataFrame(rows, "handoff_id bigint, pos int, item string"))
    assert {r.handoff_id for r in bad.collect()} == {2, 3}
    got = m.orderBy("msg_idx").collect()
    assert [r.role for r in got] == ["user", "tool", "assistant"] and json.loads(got[1].content)["tool_result"]["output"] == "r"


def test_pinned_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "d"))
    file = next((tmp_path / "d").glob("*.parquet"))
    assert scans.pinned_parquet(spark, str(file), hashlib.sha256(file.read_bytes()).hexdigest()).count() == 3
    with pytest.raises(ValueError, match="pinned"):
        scans.pinned_parquet(spark, str(file), "0" * 64)


def test_runs_and_repositories(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    line = lambda k: json.dumps({"record_type": k})
    (tmp_path / "runs/a.jsonl").write_text("\n".join(map(line, ["header", *["observation"] * 3, "footer"])))
    (tmp_path / "runs/b.jsonl").write_text("\n".join(map(line, ["header", *["observation"] * 3])))
    assert sorted((r.file[-7:], r.complete) for r in scans.result_runs(spark, str(tmp_path / "runs")).collect()) == [("a.jsonl", True), ("b.jsonl", False)]
    (tmp_path / "src/x").mkdir(parents=True)
    (tmp_path / "src/x/a.py").write_text("One\ntwo Needle\nthree\n")
    (tmp_path / "src/b.py").write_text("needle\n")
    rows = scans.repository_lines(spark, str(tmp_path / "src")).cache()
    assert [(r.path[-4:], r.line_no) for r in scans.search(rows, "NEEDLE").collect()] == [("b.py", 1), ("a.py", 2)]
    path = rows.where("path like '%a.py'").first().path
    assert [r.line for r in scans.read_range(rows, path, 2, 3).orderBy("line_no").collect()] == ["two Needle", "three"] and scans.paths(rows, path[:-4]).count() == 1


def test_sinks(spark, tmp_path):
    f = make(spark, [message(1, 0, "a@b.org"), message(2, 0, "x")])
    r = reports(f, run_policies(f, [redact(["email"])]))
    for _ in range(2):
        sinks.append_audit(r, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4
    text = {x.handoff_id: x.t for x in r.select("handoff_id", sinks.report_text().alias("t")).collect()}
    assert "sender -> receiver\nhandoff: 1\nstatus: passed" in text[1] and "redactions: 1" in text[1] and "failure" not in text[1]
    sinks.write_packets(f.handoffs, str(tmp_path / "p"), by="receiver")
    assert (tmp_path / "p/receiver=receiver").is_dir()


def test_text_functions(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    for t in ("a\nb\r\nc\rd", "x\n", " y\x0bz\x1c", "", "no end"):
        assert one(lines, t) == t.splitlines(keepends=True) and one(bare_lines, t) == t.splitlines()
    for t in ("  a ", "\x1c\x1fb\x85", "c"):
        assert one(strip, t) == t.strip()
    assert one(normal_key, " To-Do! ") == "to_do" and one(snake_code, "BudgetExceededError") == "budget_exceeded"


def test_globs():
    import fnmatch
    import re

    for glob in ("*", "a*b", "?x", "[ab]c", "[!ab]c", "a.b+", "[", "[]x]", "x[!]y]", "a\\d", "[a-c]*"):
        for name in ("", "ab", "axxb", "yx", "ac", "bc", "zc", "a.b+", "[", "]", "x", "xzy", "x]y", "a\\d", "a\nb", "cat"):
            assert bool(re.match(glob_regex(glob).replace(r"\z", r"\Z"), name)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_strict_json():
    assert ev.strict_load('{"a":{"b":1}}') == {"a": {"b": 1}}
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "[Infinity]", "x"):
        with pytest.raises(ValueError):
            ev.strict_load(bad)


def test_samples_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([(f"i{i}", f"r{i % 7}", str(i % 3)) for i in range(200)], "instance_id string, repo string, difficulty string")
    a, b = ({(r.instance_id, r.split) for r in ev.splits(x, "s", {"dev": 30, "test": 50}).collect()} for x in (rows, rows.orderBy(F.desc("instance_id")).repartition(3)))
    assert a == b and len(a) == 80 and len({i for i, _ in a}) == 80
    assert {i for i, s in a if s == "dev"} and rows.join(spark.createDataFrame(sorted(a), "instance_id string, split string"), "instance_id").where("split = 'dev'").select("repo").distinct().count() == 7


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    shape = stream.KEYED
    spark.createDataFrame([("s", "k", "pending_work", 1, "todo"), ("s", "k", "completed_work", 2, "done"), ("s", "j", "pending_work", 3, "open")], shape).coalesce(1).write.json(str(src / "a"))
    spark.createDataFrame([("s", "k", "pending_work", 4, "again"), ("s", "j", "pending_work", 2, "late")], shape).coalesce(1).write.json(str(src / "b"))
    rows = spark.readStream.schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(src))
    q = stream.last_writer(rows).writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.state_key, r.section): r for r in spark.table("changes").orderBy("place").collect()}
    assert got["k", "completed_work"].alive and got["j", "pending_work"].place == 3
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "t string, event_type string, value double").selectExpr("timestamp(t) as ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = stream.event_counts(live).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r.value) for r in spark.table("counts").collect()] == [(2, 3.0)]
