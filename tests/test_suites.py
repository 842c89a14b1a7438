"""Model replies, suites of cases, stores and training examples."""

import json
import time

import pytest
from pyspark.sql import functions as F

from hushframe.operators import evaluate, training
from hushframe.operators.proposals import Reply, graded, judged, parsed_spans, parsed_verdicts, profile, proposed
from hushframe.plans.blind import blinded
from hushframe.sources.cases import HELDOUT, generated_cases, heldout_cases, parse_cases, read_cases, read_note, write_cases
from hushframe.sources.policies import POLICIES
from hushframe.sources.stores import audit_events, local_store, tail

CLIENT = POLICIES["client_strategy"]
CASE = "line_no long, case_id string, raw string, canaries array<string>, expected_field_types array<string>, expected_semantics array<string>"


def cases(spark, *rows):
    return spark.createDataFrame([(i + 1, f"c{i + 1}", raw, c, k, ["meaning"]) for i, (raw, c, k) in enumerate(rows)], CASE)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_span_replies(spark):
    text = F.lit("call the roofing guy, the roofing guy")
    out = one(spark, '{"spans":[{"text":"the roofing guy","field_type":"business_relationship","confidence":1.2},{"text":"the roofing guy","field_type":"business_relationship"}]}', lambda v: parsed_spans(v, text))
    assert (out.accepted, out.rejected, out.spans[0].start, out.spans[0].confidence) == (1, 1, 5, 1.0)
    out = one(spark, 'so {"spans":[{"text":"nope","field_type":"date"},{"text":"call","field_type":"zzz"},7,{"text":" ","field_type":"date"},{"text":"call","field_type":"date","confidence":"x"}]} end', lambda v: parsed_spans(v, text))
    assert (out.proposed, out.accepted, out.rejected, out.spans[0].confidence) == (5, 1, 4, 0.5)
    for broken in ("not json", "[]", '{"spans": 3}', ""):
        assert one(spark, broken, lambda v: parsed_spans(v, text)).json_failure


def test_verdict_replies(spark):
    assert one(spark, '{"verdicts":[{"i":1,"v":"hide"},{"i":"2","v":"keep"},{"i":3,"v":" UNSURE"},{"i":"x","v":"hide"},{"i":1,"v":"keep"}]}', parsed_verdicts) == {1: "keep", 2: "keep", 3: "unsure"}
    assert one(spark, "not json", parsed_verdicts) is None


@pytest.mark.parametrize(("answer", "triage", "accepted"), [("hide", False, 2), ("keep", False, 0), ("unsure", False, 0), ("unsure", True, 2), ("keep", True, 0)])
def test_votes(spark, answer, triage, accepted):
    rows = cases(spark, ("The silent partner waits. Our vendor stalls.", [], []))
    out = graded(rows, lambda p: Reply(json.dumps({"verdicts": [{"i": i, "v": answer} for i in range(1, 20)]})), CLIENT, triage=triage).first()
    assert out.llm_spans_proposed == len(out.llm_spans) + out.llm_spans_rejected
    assert (out.llm_spans_accepted > 0) == (accepted > 0)


def test_no_candidates_no_call(spark):
    def never(prompt):
        raise AssertionError("asked")

    assert graded(cases(spark, ("hello", [], [])), never, CLIENT).first().llm_spans_proposed == 0


def test_failed_calls_are_counted(spark):
    rows = cases(spark, ("The vendor stalls", [], []))
    assert proposed(rows, lambda p: Reply(timed_out=True, ok=False)).first().llm_timeouts == 1
    assert proposed(rows, lambda p: Reply(ok=False)).first().llm_transport_failures == 1
    assert proposed(rows, lambda p: Reply("?")).first().llm_json_failures == 1


def test_profiles():
    assert [profile(x) for x in ("contextual_span_v2", "coreference", None, "zzz")] == ["contextual", "coreference", "strict", "strict"]


def test_the_judge_sees_safe_text_only(spark):
    rows = spark.createDataFrame([("safe words", ["m"], "SECRET")], "safe_text string, expected_semantics array<string>, raw string")

    def client(prompt):
        return Reply(json.dumps({"semantic_preservation_score": 0.0 if "SECRET" in prompt else 1.7, "missing_semantics": ["a", "b"], "overredaction": True}))

    out = judged(rows, client).first()
    assert (out.judged_ok, out.judged_score, out.judged_missing, out.judged_overredaction) == (True, 1.0, 2, True)
    assert not judged(rows, lambda p: Reply("no")).first().judged_ok


def test_suite_with_help(spark):
    rows = cases(spark, ("Bob Calder at Smith Roofing pays $75/day in Detroit.", ["Bob Calder", "Smith Roofing", "$75/day", "Detroit"], ["person_name", "business_name", "budget", "location"]))
    out = evaluate.totals(evaluate.evaluated(rows, CLIENT)).first()
    assert (out.cases_total, out.cases_passed, out.hard_leaks, out.reveal_map_leaks) == (1, 1, 0, 0)


def test_suite_without_help(spark):
    rows = cases(spark, ("We spoke of the situation from our last sync.", ["the situation from our last sync"], ["business_relationship"]))
    out = evaluate.totals(evaluate.evaluated(rows, CLIENT, fixture_transform=False)).first()
    assert (out.cases_passed, out.hard_leaks, out.removed_by_fixture_canary, out.cases_failed_without_fixture_transform, out.cases_where_fixture_would_have_saved) == (0, 1, 0, 1, 1)


def test_a_variant_is_removed(spark):
    rows = cases(spark, ("Call the roofing guy after lunch.", ["Smith Roofing"], ["business_name"]))
    out = evaluate.totals(evaluate.evaluated(rows, CLIENT)).first()
    assert out.cases_passed == 1 and out.removed_by_fixture_canary > 0


def test_model_lane_and_breaker(spark):
    text = "We spoke of the situation from our last sync."
    rows = cases(spark, *[(text, ["the situation from our last sync"], ["business_relationship"])] * 3)

    def good(prompt):
        return Reply('{"spans":[{"text":"the situation from our last sync","field_type":"business_relationship","confidence":0.9}]}', latency_ms=5.0)

    out = evaluate.totals(evaluate.evaluated(rows, CLIENT, fixture_transform=False, client=good, max_cases=2)).first()
    assert (out.cases_passed, out.cases_where_llm_prevented_failure, out.cases_where_llm_changed_output, out.llm_spans_accepted, out.p50_llm_latency_ms) == (2, 2, 2, 2, 5.0)
    out = evaluate.totals(evaluate.evaluated(rows, CLIENT, fixture_transform=False, client=lambda p: Reply(timed_out=True, ok=False))).first()
    assert (out.cases_passed, out.llm_timeouts) == (0, 1)


def test_calls_are_bounded_and_stop(spark, tmp_path):
    """A client that counts its calls: never more than max_cases, no wave after a failed call, none a second time."""
    rows = cases(spark, *[("We spoke.", [], [])] * 40)
    log = tmp_path / "calls"
    log.mkdir()

    def counting(ok):
        def client(prompt):
            import uuid

            (log / uuid.uuid4().hex).touch()
            return Reply('{"spans":[]}', ok=ok)

        return client

    def calls():
        n = len(list(log.iterdir()))
        for f in log.iterdir():
            f.unlink()
        return n

    asked = lambda df: evaluate.proposed(df, counting(True))
    out = evaluate.with_replies(rows, asked, 3, False)
    assert out.count() == 40 and out.where("llm_used").count() == 3 and calls() == 3
    assert evaluate.with_replies(rows, asked, 0, False).where("llm_used").count() == 0 and calls() == 0
    assert evaluate.with_replies(rows, asked, None, False).where("llm_used").count() == 40 and calls() == 40
    failing = lambda df: evaluate.proposed(df, counting(False))
    out = evaluate.with_replies(rows, failing, None, False)
    assert out.where("llm_used").count() == 1 and out.agg(F.sum("llm_transport_failures")).first()[0] == 1 and calls() <= evaluate.WAVE
    out = evaluate.totals(evaluate.evaluated(rows, CLIENT, client=counting(False), required=True)).first()
    assert (out.cases_total, out.cases_passed, out.json_or_process_failures) == (40, 0, 40) and calls() == 40
    verdicts = rows.selectExpr("line_no", "raw AS safe_text", "expected_semantics", "named_struct('passed', true) AS verification")
    judge = evaluate.usefulness(verdicts, counting(False), max_cases=30).first()
    assert judge.usefulness_failures == 1 and calls() <= evaluate.WAVE


def test_waves(spark):
    rows = spark.range(10, 60).withColumnRenamed("id", "line_no")
    assert list(evaluate.waves(rows)) == [17, 33, 59]
    assert list(evaluate.waves(rows.limit(0))) == [] and list(evaluate.waves(spark.range(3).withColumnRenamed("id", "line_no"))) == [2]
    many = list(evaluate.waves(spark.range(20_000).withColumnRenamed("id", "line_no")))
    assert many[0] == 7 and many[-1] == 19_999 and many == sorted(set(many)) and len(many) < 15


def test_ranks_of_counted_values(spark):
    values = [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, 9.0]
    counted = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(values.count(v)).cast("long").alias("n")) for v in (1.0, 2.0, 5.0, 9.0)))
    plain = F.array(*map(F.lit, values))
    for p in (0, 10, 25, 50, 75, 95, 100):
        a, b = spark.range(1).select(evaluate.nearest_rank_counted(counted, p), evaluate.nearest_rank(plain, p)).first()
        assert a == b
    none = F.array().cast("array<struct<v:double,n:long>>")
    assert spark.range(1).select(evaluate.nearest_rank_counted(none, 50)).first()[0] == 0.0


def test_many_latencies(spark):
    """A rank takes one walk over the values: the square of 30,000 would take minutes."""
    counted = F.array_sort(F.collect_list(F.struct((F.col("id") / 10).alias("v"), F.lit(2).cast("long").alias("n"))))
    values = spark.range(30_000).agg(counted.alias("c"))
    began = time.monotonic()
    assert tuple(values.select(*(evaluate.nearest_rank_counted(F.col("c"), p) for p in (50, 95))).first()) == (1500.0, 2849.9)
    assert time.monotonic() - began < 20


def test_latencies_of_cases(spark):
    out = evaluate.totals(evaluate.evaluated(cases(spark, *[("Bob Calder called.", [], [])] * 5), CLIENT)).first()
    assert 0 < out.p50_latency_ms <= out.p95_latency_ms <= out.max_latency_ms
    assert evaluate.public(evaluate.totals(evaluate.evaluated(cases(spark), CLIENT))).first().max_latency_ms == 0


def test_usefulness(spark):
    rows = evaluate.evaluated(cases(spark, ("hello", [], []), ("there", [], []), ("again", [], [])), CLIENT)
    out = evaluate.usefulness(rows, lambda p: Reply('{"semantic_preservation_score":0.5,"missing_semantics":[],"overredaction":false}'), max_cases=2).first()
    assert (out.usefulness_cases_judged, out.usefulness_avg_score, out.usefulness_p50, out.usefulness_failures) == (2, 0.5, 0.5, 0)
    out = evaluate.usefulness(rows, lambda p: Reply("no")).first()
    assert (out.usefulness_cases_judged, out.usefulness_failures, out.usefulness_avg_score) == (0, 1, 0.0)


@pytest.mark.parametrize(("n", "p", "value"), [(20, 95, 19.0), (20, 50, 11.0), (1, 95, 1.0), (0, 50, 0.0), (6, 50, 3.0)])
def test_nearest_rank(spark, n, p, value):
    values = F.array(*(F.lit(float(i + 1)) for i in range(n))) if n else F.array().cast("array<double>")
    assert spark.range(1).select(evaluate.nearest_rank(values, p)).first()[0] == value


def test_names_of_runs():
    assert evaluate.mode_suffix() == ""
    assert evaluate.mode_suffix(llm_mode="local", strategy="grade", verdicts="triage", fixture_transform=False, judge="local") == ".fixture_off.llm_local.grade.triage.judge_local"
    assert evaluate.artifact_stem("a-b.c.") == "a_b_c"


def test_case_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"case_id":"a","raw":"hi","canaries":["x"]}\n\n{"raw":"no id"}\nnot json\n{"canaries":[]}\n')
    rows = {r.line_no: r for r in read_cases(spark, f"file://{path}").collect()}
    assert sorted(rows) == [1, 3, 4, 5] and [rows[i].broken for i in (1, 3, 4, 5)] == [False, False, True, True]
    assert rows[1].canaries == ["x"] and rows[3].case_id == "line_3" and rows[3].expected_field_types == []
    suite = read_cases(spark, f"file://{path}")
    out = evaluate.totals(evaluate.evaluated(suite, CLIENT), suite).first()
    assert (out.cases_total, out.json_or_process_failures) == (4, 2)
    assert parse_cases(spark.createDataFrame([], "line_no long, line string")).collect() == []
    note = tmp_path / "n.md"
    note.write_text("one\ntwo\n")
    assert read_note(spark, f"file://{note}").first().raw == "one\ntwo\n"


def test_lines_of_several_files(spark, tmp_path):
    for name, n in (("a.jsonl", 3), ("b.jsonl", 40), ("c.jsonl", 2)):
        (tmp_path / name).write_text("".join(json.dumps({"raw": f"{name} {i}"}) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = read_cases(spark, f"file://{tmp_path}").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in rows] == list(range(1, 46))
    assert [r.raw for r in rows] == [f"{x} {i}" for x, n in (("a.jsonl", 3), ("b.jsonl", 40), ("c.jsonl", 2)) for i in range(n)]


def test_heldout_cases(spark):
    from hushframe.functions import patterns as P

    rows = heldout_cases(spark, 200).collect()
    assert rows == heldout_cases(spark, 200).collect() and len(rows) == 200
    assert all(c in r.raw for r in rows for c in r.canaries) and {k for r in rows for k in r.expected_field_types} == set(HELDOUT)
    assert not {x for some in HELDOUT.values() for x in some} & {*P.STATUS_PHRASES, *P.LOCATIONS}
    out = evaluate.totals(evaluate.evaluated(heldout_cases(spark, 200), CLIENT, fixture_transform=False)).first()
    assert out.cases_passed < 200 and evaluate.totals(evaluate.evaluated(heldout_cases(spark, 200), CLIENT)).first().cases_passed > out.cases_passed


def test_generated_cases(spark, tmp_path):
    rows = generated_cases(spark, 40)
    got = rows.collect()
    assert got == generated_cases(spark, 40).collect() and got != generated_cases(spark, 40, seed=1).collect()
    for r in got:
        assert len(r.canaries) == len(r.expected_field_types) >= 5 and r.case_id == f"case_{r.line_no:03d}"
        assert all(c in r.raw for c in r.canaries[5:])
    write_cases(rows, f"file://{tmp_path}/out")
    assert read_cases(spark, f"file://{tmp_path}/out").count() == 40
    assert evaluate.totals(evaluate.evaluated(rows, CLIENT)).first().cases_passed == 40


def test_stores(spark, tmp_path):
    store = local_store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a1", "Bob Calder at Smith Roofing.", ["Bob Calder", "Smith Roofing"], ["person_name", "business_name"]), ("a2", "see the odd thing", ["odd thing"], ["private_note"])], "artifact_id string, raw string, canaries array<string>, kinds array<string>")
    out = blinded(rows, CLIENT, canaries="canaries", kinds="kinds")
    off = blinded(rows.where("artifact_id = 'a2'"), CLIENT, canaries="canaries", kinds="kinds", fixture_transform=False)
    store.save(out.where("artifact_id = 'a1'"), "2026-01-01T00:00:00+00:00")
    store.save(off, "2026-01-01T00:00:01+00:00")
    assert "Person_1" in store.read_safe("a1")
    with pytest.raises(PermissionError):
        store.read_safe("a2")
    with pytest.raises(KeyError):
        store.read_safe("nobody")
    with pytest.raises(PermissionError):
        store.submit_judgment("a2", "j0", "x", "2026")
    store.submit_judgment("a1", "j1", "Person_1 should call Org_1", "2026-01-02T00:00:00+00:00")
    plain = store.reveal_report("a1", "j1")
    assert plain["placeholder_count"] == 2 and plain["field_types"] == ["business_name", "person_name"]
    assert "Bob" not in str(plain) and "Smith" not in str(plain)
    assert "Bob" not in str(store.reveal_report("a1", "j1", local_full=True))
    assert store.reveal_report("a1", "j1", local_full=True, print_secrets=True)["revealed_judgment"] == "Bob Calder should call Smith Roofing"
    with pytest.raises(ValueError):
        store.reveal_report("a2", "j1")
    with pytest.raises(KeyError):
        store.reveal_report("a1", "j9")
    store.audit(out, "blind", "2026-01-01T00:00:00+00:00", "client_strategy")
    events = store.audit_events().collect()
    assert {e.event_type for e in events} == {"submit_judgment", "reveal_sanitized", "blind"}
    assert not any("Bob" in str(e) for e in events)
    assert [r.artifact_id for r in store.recent(1).collect()] == ["a2"]
    store.delete(["a1"], "2026-01-03T00:00:00+00:00")
    assert store.entries("a1").count() == 0 and [r.artifact_id for r in store.artifacts().collect()] == ["a2"]
    with pytest.raises(KeyError):
        store.read_safe("a1")
    store.save(out.where("artifact_id = 'a1'"), "2026-01-04T00:00:00+00:00")
    assert store.entries("a1").count() == 2 and "Person_1" in store.read_safe("a1")


def test_audit_counts_prefer_the_verdict(spark):
    rows = spark.createDataFrame([("a", "passed=False; hard=3; near=1; numeric=x", "failed")], "artifact_id string, verification_summary string, verification_status string")
    e = audit_events(rows, "blind", "t").first()
    assert (e.hard_leak_count, e.near_leak_count, e.numeric_leak_count, e.reveal_map_leak_count, e.verification_passed) == (3, 1, 0, 0, False)


def test_tail(spark):
    lines = spark.createDataFrame([(i, json.dumps({"event_type": "x", "artifact_id": str(i)}) if i != 3 else "bad") for i in range(5)], "line_no long, line string")
    assert [r.artifact_id for r in tail(lines, 3).collect()] == ["2", "4"]


def test_training_examples(spark):
    rows = cases(spark, ("a b c", ["a", "a", "zz", "", "c"], ["person_name"]), (None, [], []), ("none", [], []))
    out = training.examples(rows).orderBy("line_no").collect()
    assert [json.loads(r.target) for r in out] == [{"spans": [{"text": "a", "field_type": "person_name", "reason": "sensitive person name", "confidence": 0.9}, {"text": "c", "field_type": "private_note", "reason": "sensitive private note", "confidence": 0.9}]}, {"spans": []}]
    extra = cases(spark, ("extra", [], [])).drop("expected_semantics")
    parts = training.split(training.examples(rows, extra), last=1).collect()
    assert [r.input[-5:] for r in parts if r.split == "val"] == ["extra"] and len(parts) == 3


def test_public_totals_and_lines(spark):
    totals = evaluate.totals(evaluate.evaluated(cases(spark, ("hello", [], [])), CLIENT)).withColumn("secret", F.lit(1))
    assert "secret" not in evaluate.public(totals).columns and evaluate.public(totals).columns[:2] == ["cases_total", "cases_passed"]
    assert evaluate.summary_line(totals, "s").first()[:] == ("s", "1/1 hard=0 near=0 num=0 reveal=0 coref=0 failed=0")
    assert " prevented=0 " in evaluate.summary_line(totals, "s", with_model=True).first().line


def test_chat_over_http(monkeypatch):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from hushframe.sources.chat import LocalChat, RemoteChat, silent

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body, self.headers.get("Authorization")))
            said = body["messages"][0]["content"]
            if said == "slow":
                time.sleep(1.5)
            answer = {"local": {"message": {"content": "hi"}}, "remote": {"choices": [{"message": {"content": "there"}}]}}.get(said)
            raw = json.dumps(answer).encode() if answer else b"not json"
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert LocalChat(url, "m")("local").text == "hi" and seen[-1][0]["format"] == "json"
    assert not LocalChat(url, "m")("other").ok
    assert LocalChat(url, "m", seconds=0.2)("slow").timed_out
    assert not LocalChat("http://127.0.0.1:1/", "m")("x").ok and not silent("x").ok
    assert not RemoteChat(url, "m")("remote").ok
    monkeypatch.setenv("HUSHFRAME_REMOTE_KEY", "k")
    assert RemoteChat(url, "m")("remote").text == "there" and seen[-1][1] == "Bearer k"
    server.shutdown()
