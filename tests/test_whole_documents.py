"""Span queries read texts of any alphabet."""

import pytest

from hushframe.plans import registry

TEXTS = {
    "span_email": ("Schreib an jörg: a.b@c.com – danke", ["a.b@c.com"]),
    "span_account": ("café acct_12345 “quoted”", ["acct_12345"]),
    "span_secret": ("é0123456789abcdef0123456789abcdef 0123456789abcdef0123456789abcdef é", ["0123456789abcdef0123456789abcdef"]),
}


@pytest.mark.parametrize("name", TEXTS)
def test_documents_that_are_not_ascii(spark, tmp_path, name):
    text, want = TEXTS[name]
    spark.createDataFrame([(1, text), (2, "é")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.n, r.text) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()] == [(1, i, x) for i, x in enumerate(want)]
