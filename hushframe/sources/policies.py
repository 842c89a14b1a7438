"""Policies: which kinds of spans are replaced, and how."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.patterns import DEFAULT_FORMATS, FIELD_TYPES, SENSITIVITY

OPS = ("redact", "pseudonymize", "generalize", "ignore")


@dataclass(frozen=True)
class FieldPolicy:
    op: str
    format: str | None = None
    style: str | None = None
    confidence_threshold: float | None = None
    notes: str | None = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown op {self.op!r}")


@dataclass(frozen=True)
class Policy:
    name: str
    scope: str = "artifact"
    fields: dict[str, FieldPolicy] = field(default_factory=dict)

    def __contains__(self, field_type: str) -> bool:
        return field_type in self.fields

    # A policy is known when a plan is built, so it becomes constants of the plan rather than a join.
    def _pick(self, field_type: Column, values: dict[str, object], kind: str) -> Column:
        table = [F.lit(x).cast(t) for k, v in values.items() for x, t in ((k, "string"), (v, kind))]
        return F.try_element_at(F.create_map(*table), field_type) if table else F.lit(None).cast(kind)

    def op(self, field_type: Column) -> Column:
        return self._pick(field_type, {k: v.op for k, v in self.fields.items()}, "string")

    def format(self, field_type: Column) -> Column:
        """The placeholder's format, by policy, else by kind, else the kind with capitals."""
        return self._pick(field_type, {k: v.format or DEFAULT_FORMATS.get(k) or k.title() + "_{n}" for k, v in self.fields.items()}, "string")

    def threshold(self, field_type: Column) -> Column:
        """The least confidence; null for kinds that are not in the policy."""
        return self._pick(field_type, {k: v.confidence_threshold or 0.0 for k, v in self.fields.items()}, "double")


def sensitivity(field_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in SENSITIVITY.items() for x in item)), field_type), F.lit(0))


def to_dict(policy: Policy) -> dict:
    """As JSON holds it: unset settings are left out."""
    return {"name": policy.name, "scope": policy.scope, "fields": {k: {x: y for x, y in asdict(v).items() if y is not None} for k, v in policy.fields.items()}}


def from_dict(data: dict) -> Policy:
    """Unknown settings of a field are an error."""
    return Policy(data["name"], data.get("scope", "artifact"), {k: FieldPolicy(**v) for k, v in data["fields"].items()})


def load(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f))


def resolve(name: str, folder: str = "policies") -> Policy:
    """A path, else <folder>/<name>.json, else <folder>/<name>, else one of the policies below."""
    for path in (name, os.path.join(folder, f"{name}.json"), os.path.join(folder, name)):
        if os.path.isfile(path):
            return load(path)
    if name in POLICIES:
        return POLICIES[name]
    raise FileNotFoundError(f"no policy {name!r}")


def policy_fields(spark: SparkSession, policy: Policy) -> DataFrame:
    """The policy as a dimension of one row a field, for joins with exploded spans; at most as many rows as there are kinds."""
    rows = [(k, v.op, v.format, v.style, v.confidence_threshold) for k, v in policy.fields.items()]
    return spark.createDataFrame(rows, "field_type string, op string, format string, style string, confidence_threshold double")


# The shipped policies.  P pseudonymize, R redact, I ignore, G generalize with a style.
_STYLES = {"exact_price": "business_magnitude", "budget": "business_magnitude", "location": "region_or_generic", "date": "relative_time", "client_status": "business_status", "business_relationship": "relationship_status", "private_note": "semantic_summary"}


def _shipped(name: str, formats: dict[str, str], redacted: tuple[str, ...], ignored: tuple[str, ...] = ()) -> Policy:
    fields = {}
    for kind in FIELD_TYPES:
        if kind in ignored:
            fields[kind] = FieldPolicy("ignore")
        elif kind in redacted:
            fields[kind] = FieldPolicy("redact")
        elif kind in _STYLES:
            fields[kind] = FieldPolicy("generalize", style=_STYLES[kind])
        else:
            fields[kind] = FieldPolicy("pseudonymize", format=formats.get(kind, DEFAULT_FORMATS[kind]))
    return Policy(name, "artifact", fields)


POLICIES = {
    p.name: p
    for p in (
        _shipped("client_strategy", {}, ("api_key", "secret_token")),
        _shipped("hard_egress", {}, ("api_key", "secret_token", "email", "phone", "url", "file_path", "account_id")),
        _shipped("code_review_blind", {"person_name": "Author_{n}", "business_name": "Project_{n}"}, ("api_key", "secret_token", "phone"), ("private_note",)),
        _shipped("blind_model_eval", {"business_name": "Model_{n}"}, ("api_key", "secret_token", "email", "phone"), ("person_name", "client_status", "business_relationship", "private_note")),
    )
}
