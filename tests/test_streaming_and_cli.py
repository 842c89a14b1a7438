"""A stream of notes into the stores, and the command line."""

import json

from hushframe import cli, console
from hushframe.operators.proposals import Reply
from hushframe.sources.policies import POLICIES
from hushframe.sources.stores import local_store
from hushframe.streaming.blinding import stored


def test_stream_into_stores(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "mail bob@x.test"), ("b", "call 743-555-3824")], "artifact_id string, raw string").write.json(f"file://{source}")
    notes = spark.readStream.schema("artifact_id string, raw string").json(f"file://{source}")
    store = local_store(spark, str(tmp_path / "store"))
    stored(notes, POLICIES["client_strategy"], store, f"file://{tmp_path}/checkpoint").awaitTermination(120)
    assert store.read_safe("a") == "mail Email_1" and store.read_safe("b") == "call Phone_1"
    assert store.audit_events().count() == 2


def test_commands(spark, tmp_path, capsys):
    note = tmp_path / "n.md"
    note.write_text("Bob Calder wrote from bob@x.test.")
    parse = lambda *words: cli.run(cli.parsed(["--store", f"file://{tmp_path}/s", *words]), spark)
    (made,) = parse("blind", f"file://{note}")
    assert made["verification_status"] == "passed"
    assert parse("read-safe", made["artifact_id"]) == "Person_1 wrote from Email_1."
    judgment = parse("submit-judgment", made["artifact_id"], "Person_1 is right")["judgment_id"]
    assert parse("reveal", made["artifact_id"], judgment)["placeholder_count"] == 2
    assert len(parse("audit")) == 3 and len(parse("policies")) == 4
    suite = f"file://{tmp_path}/suite.jsonl"
    parse("make-corpus", "--n", "12", "--out", suite)
    out = parse("eval", suite, "--out", f"file://{tmp_path}/out")
    assert out["cases_total"] == 12 and out["cases_passed"] == 12
    json.dumps(out)
    # By flags, without the planted values' help, and with a model that is not there.
    out = parse("eval", "--suite", suite, "--policy", "client_strategy", "--out-dir", f"file://{tmp_path}/out", "--fixture-transform", "off", "--llm", "local", "--llm-endpoint", "http://127.0.0.1:1/", "--llm-max-cases", "5", "--llm-strategy", "grade", "--grader-verdicts", "triage", "--judge-usefulness", "local", "--judge-max-cases", "2")
    assert out["cases_total"] == 12 and out["llm_transport_failures"] <= 1 and out["aggregate_path"].endswith("suite.fixture_off.llm_local.grade.triage.judge_local.aggregate")
    assert out["usefulness_cases_judged"] == 0 and out["max_latency_ms"] > 0
    held = f"file://{tmp_path}/held.jsonl"
    parse("make-heldout", "--n", "5", "--out", held)
    assert parse("eval", held, "--out", f"file://{tmp_path}/out")["cases_total"] == 5


def test_console_and_calls(spark, tmp_path):
    note = tmp_path / "n.md"
    note.write_text("Bob Calder wrote from bob@x.test.")
    store = f"file://{tmp_path}/s"
    said = iter(["Person_1 is right", "/end"])
    answer = lambda line, **more: console.command(line, spark, store, **more)
    made = json.loads(answer(f"/blind file://{note} --policy client_strategy").split("\n", 1)[1])[0]["artifact_id"]
    assert answer(f"/read {made}") == "SAFE VIEW\nPerson_1 wrote from Email_1." and made in answer("/artifacts")
    judgment = json.loads(answer(f"/judge {made}", ask=lambda _: next(said)).split("\n", 1)[1])["judgment_id"]
    assert json.loads(answer(f"/reveal {made} {judgment}").split("\n", 1)[1])["placeholder_count"] == 2
    assert "Cancelled" in answer(f"/reveal {made} {judgment} --local-full", ask=lambda _: "no") and "only" in answer(f"/reveal {made} {judgment} --print-secrets")
    assert "Bob Calder" in answer(f"/reveal {made} {judgment} --local-full --print-secrets", ask=lambda _: console.CONFIRMED)
    assert "client_strategy" in answer("/policies") and "person_name" in answer("/policy client_strategy") and "submit_judgment" in answer("/audit")
    assert "Usage" in answer("/read") and "Unknown" in answer("/zzz") and "KeyError" in answer("/read nobody") and "/blind" in answer("/help")
    assert answer("/chat hello", client=lambda p: Reply(p.upper())).endswith("HELLO")
    lines = iter(["", "/policies", "/quit"])
    console.converse(spark, store, ask=lambda _: next(lines))
    got = console.blind_artifact(spark, store, f"file://{note}", "client_strategy")
    assert got["artifact_id"] == made and console.read_blind_artifact(spark, store, made).startswith("Person_1")
    judgment = console.submit_blind_judgment(spark, store, made, "Person_1")
    assert "Bob" not in str(console.reveal_artifact(spark, store, made, judgment))


def test_exit_codes(monkeypatch, tmp_path, capsys):
    monkeypatch.setattr("builtins.input", lambda _: "no")
    assert cli.main(["reveal", "a", "b", "--local-full"]) == 2
