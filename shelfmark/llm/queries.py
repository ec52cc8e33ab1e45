"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.benchmark_decontamination import OP2_SQL, op2_benchmark_decontamination
from shelfmark.llm.bpe_codec import op3_bpe_encoding_and_decoding
from shelfmark.llm.chat_formatting import OP8_SQL, op8_chat_formatting
from shelfmark.llm.filter_audit import OP12_SQL, op12_filter_audit
from shelfmark.llm.language_id import op7_language_id
from shelfmark.llm.lm_scoring import op5_lm_scoring
from shelfmark.llm.merkle_manifest import OP13_SQL, op13_merkle_manifest
from shelfmark.llm.ngram_jaccard_join import op4_ngram_jaccard_join
from shelfmark.llm.quality_rules import OP9_SQL, op9_quality_rules
from shelfmark.llm.source_mixing import OP11_SQL, op11_source_mixing
from shelfmark.llm.suffix_array_dedup import op10_suffix_array_dedup
from shelfmark.llm.toxicity import op6_toxicity
from shelfmark.llm.warc_transactions import OP1_SQL, op1_warc_transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_transactions, op2_benchmark_decontamination, op3_bpe_encoding_and_decoding, op4_ngram_jaccard_join,
        op5_lm_scoring, op6_toxicity, op7_language_id, op8_chat_formatting, op9_quality_rules, op10_suffix_array_dedup,
        op11_source_mixing, op12_filter_audit, op13_merkle_manifest,
    )
}

ORACLES = {
    "op1_warc_transactions": OP1_SQL, "op2_benchmark_decontamination": OP2_SQL,
    "op8_chat_formatting": OP8_SQL, "op9_quality_rules": OP9_SQL,
    "op11_source_mixing": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_merkle_manifest": OP13_SQL,
}
