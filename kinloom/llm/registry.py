"""The corpus queries and their SQL, as __spark_entry__.py registers them."""

from . import decontaminate, exact_dedup, html_extract, line_dedup, ngram_join, packing, pii, quality, sharding, source_mix, substring_dedup, vector_codes, whitening

QUERIES = {
    "op1_min_slack_packing": packing.query,
    "op2_ngram_jaccard": ngram_join.query,
    "op3_semi_markov_pii": pii.query,
    "op4_quality_trees": quality.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_sharding": sharding.query,
    "op9_decontamination": decontaminate.query,
    "op10_html_template": html_extract.query,
    "op11_vector_codes": vector_codes.query,
    "op12_whitening": whitening.query,
    "op13_source_mix": source_mix.query,
}
SQL = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op13_source_mix": source_mix.SQL,
}
