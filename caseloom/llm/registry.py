"""The operators' queries and their DuckDB SQL."""

from __future__ import annotations

from caseloom.llm import alignment, clusters, decontaminate, huffman, language, packing, pii, quality, simhash, substrings, toxicity, urlfilter, warc

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, pii.op2_pii, warc.op3_warc, language.op4_language, huffman.op5_token_files, simhash.op6_simhash,
        quality.op7_quality_rules, decontaminate.op8_decontamination, urlfilter.op9_url_filter, packing.op10_packing,
        substrings.op11_substrings, clusters.op12_clusters, alignment.op13_alignment,
    )
}
ORACLES = {
    "op3_warc": warc.SQL, "op7_quality_rules": quality.sql(), "op9_url_filter": urlfilter.SQL,
    "op11_substrings": substrings.sql(),
    "op12_clusters": clusters.sql(),
}
