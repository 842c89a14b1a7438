"""Command line: blind, eval, make-corpus, make-heldout, read-safe, submit-judgment, reveal, policies, audit, console."""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from hushframe.operators import evaluate
from hushframe.operators.proposals import Client, profile
from hushframe.plans.blind import blinded
from hushframe.session import kept, local_session, ship
from hushframe.sources.cases import generated_cases, heldout_cases, read_cases, read_note, write_cases
from hushframe.sources.chat import LocalChat, RemoteChat
from hushframe.sources.policies import POLICIES, resolve, to_dict
from hushframe.sources.stores import Stores

#: Models and addresses where none are named.
LOCAL_MODEL = "granite3.3:2b"
LOCAL_ENDPOINT = "http://127.0.0.1:11434/api/chat"


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def parser() -> argparse.ArgumentParser:
    """What each command reads may be given by place or by flag."""
    top = argparse.ArgumentParser(prog="hushframe")
    top.add_argument("--store", default=os.environ.get("HUSHFRAME_STORE", "file://" + os.path.abspath("hushframe-store")))
    top.add_argument("--cpus", default="*")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **flags: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place, nargs="?")
            p.add_argument(f"--{flags.get(place, place.replace('_', '-'))}", dest=f"{place}_flag")
        p.set_defaults(places=places)
        return p

    p = command("blind", "path", path="in")
    p.add_argument("--policy", default="client_strategy")
    p.add_argument("--out")
    p = command("eval", "suite")
    p.add_argument("--policy", default="client_strategy")
    p.add_argument("--out", "--out-dir", dest="out", required=True)
    p.add_argument("--fixture-transform", choices=("on", "off"), default="on")
    p.add_argument("--llm", choices=("none", "local", "ollama", "remote"), default="none")
    p.add_argument("--llm-model")
    p.add_argument("--llm-endpoint")
    p.add_argument("--llm-max-cases", type=int)
    p.add_argument("--llm-timeout-seconds", type=int, default=30)
    p.add_argument("--llm-required", action="store_true")
    p.add_argument("--llm-prompt-profile", choices=("strict", "contextual", "coreference"), default="strict")
    p.add_argument("--llm-strategy", choices=("propose", "grade"), default="propose")
    p.add_argument("--grader-verdicts", choices=("binary", "triage"), default="binary")
    p.add_argument("--judge-usefulness", choices=("none", "local", "remote"), default="none")
    p.add_argument("--judge-max-cases", type=int)
    for name in ("make-corpus", "make-heldout"):
        p = sub.add_parser(name)
        p.add_argument("--n", type=int, default=100)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--out", required=True)
    command("read-safe", "artifact_id")
    p = command("submit-judgment", "artifact_id", "text")
    p.add_argument("--judgment-file")
    p = command("reveal", "artifact_id", "judgment_id")
    p.add_argument("--local-full", action="store_true")
    p.add_argument("--print-secrets", "--i-understand-this-prints-secrets", dest="print_secrets", action="store_true")
    p.add_argument("--yes", action="store_true", help="confirm a full report without being asked")
    sub.add_parser("policies")
    p = sub.add_parser("audit")
    p.add_argument("--limit", type=int, default=20)
    sub.add_parser("console")
    return top


def parsed(argv: list[str] | None) -> argparse.Namespace:
    args = parser().parse_args(argv)
    for place in getattr(args, "places", ()):
        if getattr(args, place) is None:
            setattr(args, place, getattr(args, f"{place}_flag"))
        if getattr(args, place) is None and not (place == "text" and args.judgment_file):
            parser().error(f"{args.command}: {place} is missing")
    return args


def chat(mode: str, args: argparse.Namespace) -> Client | None:
    """The model that a mode names; the remote one is asked where HUSHFRAME_REMOTE_URL says."""
    if mode == "none":
        return None
    if mode == "remote":
        return RemoteChat(args.llm_endpoint or os.environ.get("HUSHFRAME_REMOTE_URL", ""), args.llm_model or os.environ.get("HUSHFRAME_REMOTE_MODEL", ""), seconds=args.llm_timeout_seconds)
    return LocalChat(args.llm_endpoint or os.environ.get("HUSHFRAME_LOCAL_URL", LOCAL_ENDPOINT), args.llm_model or LOCAL_MODEL, seconds=args.llm_timeout_seconds)


def run_suite(args: argparse.Namespace, spark, stores: Stores) -> dict:
    """A suite evaluated through the lanes that the flags name, its files written, and its public totals."""
    policy, helped = resolve(args.policy), args.fixture_transform == "on"
    suite = read_cases(spark, args.suite)
    mode = "none" if args.llm == "none" else "remote" if args.llm == "remote" else "local"
    long_name = f"{profile(args.llm_prompt_profile)}_span_v{1 + ('strict', 'contextual', 'coreference').index(profile(args.llm_prompt_profile))}"
    stem = args.suite.rstrip("/").rpartition("/")[2].rpartition(".")[0] + evaluate.mode_suffix(llm_mode=args.llm, judge=args.judge_usefulness, fixture_transform=helped, prompt_profile=long_name, strategy=args.llm_strategy, verdicts=args.grader_verdicts)
    named = stem if args.llm_max_cases is None else f"{stem}.max{args.llm_max_cases}"
    results = kept(evaluate.evaluated(suite, policy, fixture_transform=helped, client=chat(mode, args), grade=args.llm_strategy == "grade", triage=args.grader_verdicts == "triage", prompt_profile=args.llm_prompt_profile, max_cases=args.llm_max_cases, required=args.llm_required, stem=named))
    paths = {"per_case_path": f"{args.out}/{stem}.results", "aggregate_path": f"{args.out}/{stem}.aggregate"}
    evaluate.per_case(results).write.mode("overwrite").json(paths["per_case_path"])
    totals = evaluate.totals(results, suite)
    judge = chat(args.judge_usefulness, args)
    if judge is not None:
        said = kept(evaluate.usefulness(results, judge, max_cases=args.judge_max_cases))
        totals = totals.withColumn("said", said.select(F.struct("*")).scalar()).select("*", "said.*").drop("said")
    settings = {"llm_mode": args.llm, "llm_model": args.llm_model, "llm_prompt_profile": long_name, "judge_usefulness": args.judge_usefulness, "fixture_transform_enabled": helped}
    totals = kept(totals.withColumns({k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in settings.items()}))
    totals.write.mode("overwrite").json(paths["aggregate_path"])
    stores.save(results.where("verification.passed and not process_failed"), now())
    stores.audit(results, "eval_case", now(), policy.name)
    return evaluate.public(totals).first().asDict() | settings | paths


def run(args: argparse.Namespace, spark) -> object:
    stores = Stores(spark, args.store)
    if args.command == "policies":
        return [to_dict(p) for p in POLICIES.values()]
    if args.command == "blind":
        policy = resolve(args.policy)
        rows = read_note(spark, args.path).withColumn("artifact_id", F.concat(F.lit("art_"), F.substring(F.sha2(F.concat_ws("/", "path", "raw"), 256), 1, 16)))
        out = kept(blinded(rows, policy))
        stores.save(out, now())
        stores.audit(out, "blind", now(), policy.name)
        if args.out:
            out.where("verification.passed").select("artifact_id", "safe_text").write.mode("overwrite").json(args.out)
        return [r.asDict() for r in out.select("artifact_id", "verification_status", "hidden_field_types").collect()]
    if args.command == "eval":
        return run_suite(args, spark, stores)
    if args.command == "make-heldout":
        write_cases(heldout_cases(spark, args.n, args.seed), args.out)
        return {"cases": args.n, "out": args.out}
    if args.command == "make-corpus":
        write_cases(generated_cases(spark, args.n, args.seed), args.out)
        return {"cases": args.n, "out": args.out}
    if args.command == "read-safe":
        return stores.read_safe(args.artifact_id)
    if args.command == "submit-judgment":
        text = args.text if args.judgment_file is None else read_note(spark, args.judgment_file).first().raw
        return {"judgment_id": stores.submit_judgment(args.artifact_id, f"judg_{uuid.uuid4().hex[:16]}", text, now())}
    if args.command == "audit":
        return [r.asDict() for r in stores.audit_events().orderBy(F.desc("timestamp")).limit(args.limit).collect()]
    return stores.reveal_report(args.artifact_id, args.judgment_id, local_full=args.local_full, print_secrets=args.print_secrets, created_at=now())


def main(argv: list[str] | None = None) -> int:
    """0 if it worked, 1 after an error (as JSON on stderr), 2 if a full report was not confirmed."""
    args = parsed(argv)
    if args.command == "console":
        from hushframe.console import converse

        converse(ship(local_session(args.cpus)), args.store)
        return 0
    if args.command == "reveal" and args.local_full and not args.yes and input("Type REVEAL to go on: ") != "REVEAL":
        return 2
    try:
        print(json.dumps(run(args, ship(local_session(args.cpus))), default=str))
    except Exception as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)[:500]}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
