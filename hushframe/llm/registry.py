"""The named queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from hushframe.llm import decontaminate, order_minhash, quality_model, quality_rules, sentencepiece_codec, sharding, site_tree, substring_dedup, url_filter, warc
from hushframe.llm.oracles import ORACLE_SQL  # noqa: F401

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_sharding": sharding.op2_sharding,
    "op3_html_extraction": site_tree.op3_html_extraction,
    "op4_order_minhash": order_minhash.op4_order_minhash,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "quality_ablations": quality_rules.quality_ablations,
    "op6_quality_classifier": quality_model.op6_quality_classifier,
    "op7_warc": warc.op7_warc,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
