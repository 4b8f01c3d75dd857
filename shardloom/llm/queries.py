"""Registers the queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, html, jaccard, secrets, substrings, suffixes, topk, toxicity, urls, variants, warc

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_exact_topk": topk.op2_exact_topk,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_suffix_array_dedup": suffixes.op4_suffix_array_dedup,
    "op5_url_filters": urls.op5_url_filters,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_warc": warc.op13_warc,
}
SQL = {"op12_source_divergence": divergence.SQL, "op2_exact_topk": topk.SQL, "op3_benchmark_decontamination": decontaminate.SQL, "op5_url_filters": urls.SQL, "op6_substring_dedup": substrings.SQL, "op7_ngram_jaccard": jaccard.SQL}
