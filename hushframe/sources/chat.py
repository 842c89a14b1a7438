"""Chat models over HTTP, as the callables that operators.proposals asks.

They hold addresses and names only, so they can be sent to workers; the remote one
reads its key from the environment where it runs.  A reply that comes too late is
timed out, anything else that is no reply has failed.
"""

from __future__ import annotations

import http.client
import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from hushframe.operators.proposals import Reply


def post(url: str, body: dict, headers: dict[str, str], seconds: float) -> tuple[dict | None, Reply]:
    """The JSON object that a server answers with, and a reply that says how it went."""
    began = time.perf_counter()
    took = lambda: (time.perf_counter() - began) * 1000
    call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers, method="POST")
    try:
        with urllib.request.urlopen(call, timeout=seconds) as answer:
            found = json.loads(answer.read())
    except TimeoutError:
        return None, Reply(ok=False, timed_out=True, latency_ms=took())
    except urllib.error.URLError as e:
        return None, Reply(ok=False, timed_out=isinstance(e.reason, TimeoutError), latency_ms=took())
    except (http.client.HTTPException, OSError, ValueError):
        return None, Reply(ok=False, latency_ms=took())
    return (found if isinstance(found, dict) else {}), Reply(latency_ms=took())


def said(answer: dict) -> str:
    """The text of an answer, of either common shape."""
    choices = answer.get("choices") or [answer]
    return str((choices[0].get("message") or {}).get("content", ""))


def _user(prompt: str) -> list[dict[str, str]]:
    return [{"role": "user", "content": prompt}]


@dataclass(frozen=True)
class LocalChat:
    """A model server on this machine, made to answer in JSON at temperature 0."""

    endpoint: str
    model: str
    seconds: float = 30

    def __call__(self, prompt: str) -> Reply:
        body = {"model": self.model, "messages": _user(prompt), "stream": False, "format": "json", "options": {"temperature": 0}}
        answer, reply = post(self.endpoint, body, {}, self.seconds)
        return reply if answer is None else Reply(said(answer), latency_ms=reply.latency_ms)


@dataclass(frozen=True)
class RemoteChat:
    """A remote chat completion service; without an address, a model or a key every call fails."""

    url: str = ""
    model: str = ""
    key_variable: str = "HUSHFRAME_REMOTE_KEY"
    seconds: float = 30

    def __call__(self, prompt: str) -> Reply:
        key = os.environ.get(self.key_variable)
        if not (key and self.url and self.model):
            return Reply(ok=False)
        answer, reply = post(self.url, {"model": self.model, "messages": _user(prompt), "temperature": 0}, {"Authorization": f"Bearer {key}"}, self.seconds)
        return reply if answer is None else Reply(said(answer), latency_ms=reply.latency_ms)


def silent(prompt: str) -> Reply:
    """No model at all."""
    return Reply(ok=False)
