"""Artifacts, reveal maps, judgments and the audit trail as tables of files.

Each store is a folder.  Rows are appended; an artifact that is saved again is a later
row, and reads take the last one by (created_at, version).  Nothing is rewritten, so
writers do not wait for each other and a failed write leaves nothing behind.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from hushframe.operators.rewrite import revealed
from hushframe.operators.verify import summary_count

ARTIFACT = "artifact_id string, safe_text string, policy_name string, hidden_field_types array<string>, canary_count int, verification_status string, verification_summary string, input_sha256 string, safe_sha256 string, created_at string"
ENTRY = "artifact_id string, scope_id string, field_type string, placeholder string, original_value string, original_sha256 string, created_at string"
JUDGMENT = "judgment_id string, artifact_id string, judgment_text string, created_at string"
EVENT = "artifact_id string, canary_count int, event_type string, hard_leak_count int, hidden_field_types array<string>, input_sha256 string, near_leak_count int, numeric_leak_count int, policy_name string, reveal_map_leak_count int, safe_sha256 string, timestamp string, verification_passed boolean"


def as_schema(rows: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, in order; missing ones are null."""
    kinds = [(part.split(" ", 1)) for part in schema.split(", ")]
    return rows.select(*((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in kinds))


@dataclass(frozen=True)
class Stores:
    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, name: str, schema: str) -> None:
        as_schema(rows, schema).write.mode("append").parquet(self._path(name))

    def save(self, rows: DataFrame, created_at: str, scope: str | None = None) -> None:
        """Rows of blinded(): those that passed become artifacts with their reveal entries; the rest leave only a status.

        A failed artifact's text and entries are not kept.
        """
        stamped = rows.withColumns({"created_at": F.lit(created_at), "safe_text": F.when(F.col("verification.passed"), F.col("safe_text")).otherwise("")})
        self._append(stamped, "artifacts", ARTIFACT)
        entries = rows.where("verification.passed").select("artifact_id", (F.col(scope) if scope else F.col("artifact_id")).alias("scope_id"), F.inline("reveal_entries")).withColumn("created_at", F.lit(created_at))
        self._append(entries, "reveal_map", ENTRY)

    def delete(self, artifact_ids: list[str] | DataFrame, created_at: str) -> None:
        """From now on the artifacts (a list, or a table of artifact_id) and their reveal entries are gone from all reads; saving them again brings them back."""
        rows = self.spark.createDataFrame([(x,) for x in artifact_ids], "artifact_id string") if isinstance(artifact_ids, list) else artifact_ids.select("artifact_id")
        self._append(rows.withColumns({"verification_status": F.lit("deleted"), "created_at": F.lit(created_at)}), "artifacts", ARTIFACT)

    def artifacts(self) -> DataFrame:
        """The last row of each artifact, of equal times that of a deletion."""
        last = W.partitionBy("artifact_id").orderBy(F.desc("created_at"), (F.col("verification_status") != "deleted"))
        return self._read("artifacts", ARTIFACT).withColumn("hf_n", F.row_number().over(last)).where("hf_n = 1 and verification_status != 'deleted'").drop("hf_n")

    def recent(self, n: int) -> DataFrame:
        return self.artifacts().orderBy(F.desc("created_at"), "artifact_id").limit(n)

    def entries(self, artifact_id: str | None = None) -> DataFrame:
        """What placeholders stand for, as the artifact's last saving has it."""
        saved = self.artifacts().where("verification_status = 'passed'").select("artifact_id", "created_at")
        rows = self._read("reveal_map", ENTRY).join(saved, ["artifact_id", "created_at"], "left_semi").dropDuplicates(["artifact_id", "scope_id", "field_type", "original_sha256"])
        return rows.where(F.col("artifact_id") == artifact_id).orderBy("field_type", "placeholder") if artifact_id else rows

    def judgments(self) -> DataFrame:
        return self._read("judgments", JUDGMENT)

    def _artifact(self, artifact_id: str):
        row = self.artifacts().where(F.col("artifact_id") == artifact_id).first()
        if row is None:
            raise KeyError(f"unknown artifact {artifact_id}")
        return row

    def read_safe(self, artifact_id: str) -> str:
        """The safe text of an artifact that passed."""
        row = self._artifact(artifact_id)
        if row.verification_status != "passed":
            raise PermissionError("the artifact failed verification and cannot be read as safe text")
        return row.safe_text

    def submit_judgment(self, artifact_id: str, judgment_id: str, text: str, created_at: str) -> str:
        self.read_safe(artifact_id)
        self._append(self.spark.createDataFrame([(judgment_id, artifact_id, text, created_at)], JUDGMENT), "judgments", JUDGMENT)
        self.audit(self.spark.createDataFrame([(artifact_id,)], "artifact_id string"), "submit_judgment", created_at)
        return judgment_id

    def submit_judgments(self, rows: DataFrame, created_at: str) -> None:
        """Many judgments (judgment_id, artifact_id, judgment_text) at once: those of artifacts that passed are kept, the others are not."""
        passed = self.artifacts().where("verification_status = 'passed'").select("artifact_id")
        self._append(rows.join(passed, "artifact_id", "left_semi").withColumn("created_at", F.lit(created_at)), "judgments", JUDGMENT)

    def reports(self) -> DataFrame:
        """(judgment_id, artifact_id, placeholder_count, field_types) of all judgments: reveal_report()'s counts and kinds, never values."""
        saved = self.entries().groupBy("artifact_id").agg(F.count("*").alias("placeholder_count"), F.array_sort(F.collect_set("field_type")).alias("field_types"))
        none = F.array().cast("array<string>")
        return self.judgments().select("judgment_id", "artifact_id").join(saved, "artifact_id", "left").select("judgment_id", "artifact_id", F.coalesce("placeholder_count", F.lit(0)).alias("placeholder_count"), F.coalesce("field_types", none).alias("field_types"))

    def reveal_report(self, artifact_id: str, judgment_id: str, *, local_full: bool = False, print_secrets: bool = False, created_at: str = "") -> dict:
        """What is behind a judgment's placeholders: counts and kinds; hashes with local_full, values only with both."""
        self._artifact(artifact_id)
        judgment = self.judgments().where(F.col("judgment_id") == judgment_id).first()
        if judgment is None:
            raise KeyError(f"unknown judgment {judgment_id}")
        if judgment.artifact_id != artifact_id:
            raise ValueError("the judgment is of another artifact")
        entries = self.entries(artifact_id)
        shown = entries.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("field_type")).alias("kinds")).first()
        out = {"artifact_id": artifact_id, "judgment_id": judgment_id, "mode": "sanitized_comparison_report", "placeholder_count": shown.n, "field_types": shown.kinds, "safe_judgment_chars": len(judgment.judgment_text)}
        if local_full:
            out["mode"] = "local_full_with_secrets" if print_secrets else "local_full_no_secrets"
            out["placeholder_hashes"] = [r.asDict() for r in entries.select("field_type", "placeholder", "original_sha256").collect()]
            if print_secrets:
                all_entries = entries.agg(F.array_sort(F.collect_list(F.struct("field_type", "placeholder", "original_value"))).alias("e"))
                out["revealed_judgment"] = all_entries.select(revealed(F.lit(judgment.judgment_text), F.col("e"))).first()[0]
        self.audit(self.spark.createDataFrame([(artifact_id,)], "artifact_id string"), "reveal_sanitized", created_at)
        return out

    def audit(self, rows: DataFrame, event_type: str, timestamp: str, policy_name: str | None = None) -> None:
        """Append one event a row, as JSON; only hashes, kinds and counts."""
        audit_events(rows, event_type, timestamp, policy_name).write.mode("append").json(self._path("audit"))

    def audit_events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENT).json(self._path("audit"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENT)


def audit_events(rows: DataFrame, event_type: str, timestamp: str, policy_name: str | None = None) -> DataFrame:
    """Events of EVENT, fields by name.  Counts come from a verification if there is one, else from its one-line summary."""
    has = rows.columns
    line: Column | None = F.col("verification_summary") if "verification_summary" in has else None
    parsed = {k: summary_count(line, k) if line is not None else F.lit(0) for k in ("hard", "near", "numeric", "reveal_map")}
    exact = {"hard": "hard_leaks", "near": "near_leaks", "numeric": "numeric_leaks", "reveal_map": "reveal_map_leaks"}
    counts = {f"{k}_leak_count": F.coalesce(F.col(f"verification.{exact[k]}"), v) if "verification" in has else v for k, v in parsed.items()}
    status = F.col("verification_status") == "passed" if "verification_status" in has else F.lit(None).cast("boolean")
    passed = F.coalesce(F.col("verification.passed"), status) if "verification" in has else status
    none = F.array().cast("array<string>")
    fields = counts | {"event_type": F.lit(event_type), "timestamp": F.lit(timestamp), "policy_name": F.lit(policy_name).cast("string"), "verification_passed": passed, "hidden_field_types": F.coalesce("hidden_field_types", none) if "hidden_field_types" in has else none, "canary_count": F.coalesce("canary_count", F.lit(0)) if "canary_count" in has else F.lit(0)}
    return as_schema(rows.withColumns(fields), EVENT)


def tail(lines: DataFrame, n: int, schema: str = EVENT) -> DataFrame:
    """Of (line_no, line), the last n lines that can be read, in order."""
    last = lines.orderBy(F.desc("line_no")).limit(n)
    return last.withColumn("event", F.from_json("line", schema)).where("event.event_type is not null").orderBy("line_no").select("line_no", "event.*")


def local_store(spark: SparkSession, folder: str) -> Stores:
    return Stores(spark, "file://" + os.path.abspath(folder))
