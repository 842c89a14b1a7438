"""Commands of a console, and the calls that an assistant may make: thin forms of the command line's."""

from __future__ import annotations

import json
import shlex
from collections.abc import Callable

from pyspark.sql import SparkSession

from hushframe import cli
from hushframe.operators.proposals import Client
from hushframe.sources.chat import LocalChat
from hushframe.sources.policies import POLICIES, resolve, to_dict
from hushframe.sources.stores import Stores

# What a console calls its views.
SAFE, EVAL, REVEAL, CHAT = "SAFE VIEW", "EVAL VIEW", "LOCAL REVEAL VIEW", "LOCAL CHAT VIEW"
CONFIRMED = "LOCAL REVEAL"
USAGE = {
    "/blind": "<path> --policy <name>",
    "/read": "<artifact_id>",
    "/eval": "<suite> --policy <name> [--out <folder>]",
    "/judge": "<artifact_id>",
    "/reveal": "<artifact_id> <judgment_id> [--local-full [--print-secrets]]",
    "/policies": "",
    "/policy": "<name>",
    "/audit": "",
    "/artifacts": "",
    "/chat": "<prompt>",
    "/quit": "",
}


def shown(view: str, value: object) -> str:
    return f"{view}\n" + (value if isinstance(value, str) else json.dumps(value, indent=2, sort_keys=True, default=str))


def command(line: str, spark: SparkSession, store: str, *, ask: Callable[[str], str] = input, client: Client | None = None) -> str:
    """The answer to one line; errors are part of it."""
    try:
        name, *words = shlex.split(line) or ["/help"]
        if name == "/help":
            return shown(SAFE, "\n".join(f"{k} {v}".rstrip() for k, v in USAGE.items()))
        if name not in USAGE:
            return shown(SAFE, "Unknown command; /help lists them.")
        least = USAGE[name].split("[")[0].count("<")
        if len([w for w in words if not w.startswith("--")]) < least:
            return shown(SAFE, f"Usage: {name} {USAGE[name]}")
        return _answer(name, words, spark, store, ask, client)
    except Exception as e:
        return shown(SAFE, f"Local error: {type(e).__name__}: {e}")


def _answer(name: str, words: list[str], spark: SparkSession, store: str, ask: Callable[[str], str], client: Client | None) -> str:
    run = lambda *argv: cli.run(cli.parsed(["--store", store, *argv]), spark)
    if name == "/blind":
        return shown(SAFE, run("blind", *words))
    if name == "/read":
        return shown(SAFE, run("read-safe", *words))
    if name == "/eval":
        return shown(EVAL, run("eval", *words, *([] if "--out" in words else ["--out", f"{store.rstrip('/')}/evals"])))
    if name == "/judge":
        lines: list[str] = []
        while (text := ask("judgment> ")) != "/end":
            lines.append(text)
        return shown(SAFE, run("submit-judgment", words[0], "\n".join(lines)))
    if name == "/reveal":
        if "--print-secrets" in words and "--local-full" not in words:
            return shown(REVEAL, "Values are printed with --local-full only.")
        if "--local-full" in words and ask(f"Type {CONFIRMED} to go on: ") != CONFIRMED:
            return shown(REVEAL, "Cancelled.")
        return shown(REVEAL, run("reveal", *words))
    if name == "/policies":
        return shown(SAFE, "\n".join(sorted(POLICIES)))
    if name == "/policy":
        return shown(SAFE, to_dict(resolve(words[0])))
    if name == "/audit":
        return shown(SAFE, run("audit"))
    if name == "/artifacts":
        return shown(SAFE, "\n".join(f"{r.artifact_id} {r.verification_status}" for r in Stores(spark, store).recent(12).collect()))
    if name == "/chat":
        reply = (client or LocalChat(cli.LOCAL_ENDPOINT, cli.LOCAL_MODEL))(" ".join(words))
        return shown(CHAT, reply.text if reply.ok else "The model did not answer.")
    return ""


def converse(spark: SparkSession, store: str, *, ask: Callable[[str], str] = input) -> None:
    """Commands line by line, until /quit or the end of input."""
    while True:
        try:
            line = ask("> ")
        except EOFError:
            return
        if line.strip() in ("/quit", "/exit"):
            return
        if line.strip():
            print(command(line, spark, store, ask=ask))


def blind_artifact(spark: SparkSession, store: str, path: str, policy: str) -> dict:
    """For an assistant: a file blinded and stored; ids and kinds only."""
    (made,) = cli.run(cli.parsed(["--store", store, "blind", path, "--policy", policy]), spark)
    return {"artifact_id": made["artifact_id"], "hidden_field_types": made["hidden_field_types"], "canary_count": 0}


def read_blind_artifact(spark: SparkSession, store: str, artifact_id: str) -> str:
    return Stores(spark, store).read_safe(artifact_id)


def submit_blind_judgment(spark: SparkSession, store: str, artifact_id: str, judgment: str) -> str:
    return cli.run(cli.parsed(["--store", store, "submit-judgment", artifact_id, judgment]), spark)["judgment_id"]


def reveal_artifact(spark: SparkSession, store: str, artifact_id: str, judgment_id: str) -> dict:
    """The report without values."""
    return cli.run(cli.parsed(["--store", store, "reveal", artifact_id, judgment_id]), spark)
