"""Notes blinded as they arrive.

A note needs nothing but itself: detection, rewriting, numbering and verification stay
within the row, so the batch plan runs on a stream without state or a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hushframe.plans.blind import blinded
from hushframe.sources.policies import Policy
from hushframe.sources.stores import Stores


def blinded_stream(notes: DataFrame, policy: Policy, **options) -> DataFrame:
    """blinded() of a stream of notes."""
    return blinded(notes, policy, **options)


def stored(notes: DataFrame, policy: Policy, stores: Stores, checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Run a stream into the stores: artifacts, reveal maps and audit events of every micro-batch.

    A batch that is run again writes rows again; reads of artifacts and entries take one
    for each key, so the stores' contents are the same.
    """

    def batch(rows: DataFrame, number: int) -> None:
        stamp = f"batch-{number:012d}"
        held = rows.persist()
        stores.save(held, stamp)
        stores.audit(held, "blind", stamp, policy.name)
        held.unpersist()

    return blinded(notes, policy, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
