"""Work on notes is dealt out to all cores, though the customers that they are made of are few bytes in one row group."""

import pytest

from hushframe.plans import registry


@pytest.mark.parametrize("name", ["pseudonym_numbers", "verdict_apply", "proposal_parse", "span_status_idiom", "verdict_parse", "infer_type", "span_labeled_key"])
def test_notes_are_dealt_out(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
