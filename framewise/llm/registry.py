"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, decontamination, jaccard_join, merkle, quality_classifier, quality_rules, sentencepiece_bpe, suffix_dedup, token_counts, toxicity, url_filters, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_ngram_jaccard_join": jaccard_join.op3_ngram_jaccard_join,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_warc": warc.op5_warc,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_sentencepiece": sentencepiece_bpe.op11_sentencepiece,
    "op12_merkle": merkle.op12_merkle,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op2_benchmark_decontamination": decontamination.SQL,
    "op3_ngram_jaccard_join": jaccard_join.SQL,
    "op5_warc": warc.SQL,
    "op6_url_filters": url_filters.SQL,
    "op12_merkle": merkle.SQL,
}
