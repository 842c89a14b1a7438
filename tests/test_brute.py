"""Detection, resolution, rewriting and candidates against plain Python, over all documents and planted texts."""

import hashlib
import re

import pytest

from hushframe.functions import patterns as P
from hushframe.plans import notes as N
from hushframe.plans import registry
from hushframe.plans.blind import blinded
from hushframe.sources.policies import POLICIES

POLICY = POLICIES["client_strategy"]


def compiled(pattern):
    flags, body = re.match(r"(?:\(\?([iU]+)\))?(.*)", pattern, re.S).groups()
    return re.compile(body, re.I if flags and "i" in flags else 0)


def found(text, pattern, kind, confidence, keep=lambda s: True):
    return [(m.start(), m.end(), kind, confidence) for m in compiled(pattern).finditer(text) if keep(m.group())]


def spans(text):
    out = []
    for kind, pattern, _, confidence in P.DETECTORS:
        if kind in POLICY:
            out += found(text, pattern, kind, confidence)
    for x in P.LOCATIONS if "location" in POLICY else ():
        out += found(text, "(?iU)" + re.escape(x), "location", 0.82)
    for x in P.STATUS_PHRASES if "client_status" in POLICY else ():
        out += found(text, "(?iU)" + re.escape(x), "client_status", 0.9)
    if "person_name" in POLICY:
        business = compiled(P.BUSINESS)
        out += found(text, P.PERSON, "person_name", 0.66, lambda s: not business.search(s) and s not in P.NOT_PERSONS)
        out += found(text, P.TITLE_NAME, "person_name", 0.7) + found(text, P.INITIAL_SURNAME, "person_name", 0.7)
        out += found(text, P.NAME_INITIAL, "person_name", 0.7, lambda s: s.split()[0] not in P.NOT_FIRST_NAMES)
    return [s for s in out if s[3] >= (POLICY.fields[s[2]].confidence_threshold or 0)]


def clusters(text):
    """[(start, end, kind of the winner)]"""
    out = []
    for seq, s in sorted(enumerate(spans(text)), key=lambda x: (x[1][0], x[1][1], x[0])):
        rank = (s[3], s[1] - s[0], P.SENSITIVITY.get(s[2], 0), -s[0], -s[1], -seq, s[2])
        if out and s[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), max(out[-1][2], rank))
        elif s[0] < s[1]:
            out.append((s[0], s[1], rank))
    return [(a, b, rank[-1]) for a, b, rank in out]


FIXED = {"location": "a regional location", "client_status": "a private client status", "business_relationship": "a private business relationship", "private_note": "a private contextual note"}


def safe(text):
    """(safe text or None where a number or date decides, kinds hidden, originals of placeholders)"""
    changed = [(a, b, kind) for a, b, kind in clusters(text) if POLICY.fields[kind].op != "ignore"]
    numbers, known = {}, {}
    for a, b, kind in reversed(changed):
        if POLICY.fields[kind].op == "pseudonymize" and (kind, text[a:b]) not in known:
            numbers[kind] = known[kind, text[a:b]] = numbers.get(kind, 0) + 1
    out, at, sure = "", 0, True
    for a, b, kind in changed:
        op = POLICY.fields[kind].op
        if op == "redact":
            new = f"[REDACTED_{kind.upper()}]"
        elif op == "pseudonymize":
            new = (POLICY.fields[kind].format or P.DEFAULT_FORMATS.get(kind) or kind.title() + "_{n}").replace("{n}", str(known[kind, text[a:b]]))
        else:
            new, sure = FIXED.get(kind, ""), sure and kind in FIXED
        out, at = out + text[at:a] + new, b
    return (out + text[at:] if sure else None), sorted({k for _, _, k in changed}), len(known)


def candidates(text, most=14):
    listed = [(m.start(), m.end()) for m in compiled(P.DETERMINER).finditer(text)]
    listed += [(m.start(), m.end()) for m in re.finditer(P.CLAUSE, text) if any(cue in m.group().lower() for cue in P.CUES)]
    out = {}
    for seq, (a, b) in enumerate(listed):
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))
        if b - a >= 5 and (a, b) not in out:
            out[a, b] = seq
    ranked = sorted(out, key=lambda p: (p[0] - p[1], out[p]))[:most]
    return [(a, b, text[a:b]) for a, b in ranked]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    extra = [(10_000 + r.note_id, r.raw) for r in N.planted(spark, sf_dir).collect()]
    odd = ["", "Ada Brook met J. Farrow. \U0001f600 Dr. Ünal, Mr. Kim Lee at Smith Roofing in bay city; the silent partner who pays.", "sk-aaaaaaaaaaaaaaaaaaaa bob@x.test bob@x.test amy@x.test", "ßword acct_12345é +1 743 555 3824x 555-1212 ~/home/é/x.md"]
    return dict(docs + extra + list(enumerate(odd, 20_000)))


def test_documents_against_plain_python(spark, texts):
    rows = blinded(spark.createDataFrame(list(texts.items()), "artifact_id long, raw string"), POLICY).collect()
    assert len(rows) == len(texts)
    sure = 0
    for r in rows:
        want, kinds, n = safe(texts[r.artifact_id])
        assert (r.hidden_field_types, len(r.reveal_entries)) == (kinds, n), texts[r.artifact_id]
        if want is not None:
            sure += 1
            assert r.safe_text == want and r.safe_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert sure > 250


def test_registered_documents(spark, sf_dir, texts):
    rows = registry.QUERIES["blind_documents"](spark, sf_dir).collect()
    for r in rows:
        _, kinds, n = safe(texts[r.artifact_id])
        assert (r.n_kinds, r.n_entries) == (len(kinds), n)


def test_candidates_against_plain_python(spark, sf_dir, texts):
    got = {}
    for r in registry.QUERIES["candidate_top14"](spark, sf_dir).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    want = {i: candidates(t) for i, t in texts.items() if i < 10_000}
    assert got == {i: c for i, c in want.items() if c}


@pytest.mark.parametrize("name", ["eval_suite", "eval_suite_fixture_off"])
def test_suites_against_the_notes(spark, sf_dir, name):
    """Every planted value of every note is removed, with help and without; nothing is counted twice."""
    r = registry.QUERIES[name](spark, sf_dir).first()
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert (r.cases_total, r.cases_passed, r.hard_leaks, r.near_leaks, r.numeric_leaks, r.reveal_map_leaks, r.json_or_process_failures) == (n, n, 0, 0, 0, 0, 0)


def test_generated_corpus(spark, sf_dir):
    rows = registry.QUERIES["corpus_cases"](spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert len(rows) == n == len({r.case_id for r in rows}) and all(r.verification_passed for r in rows)
