"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, checks, decontaminate, divergence, fill_middle, html_text, licences, neardup, repeats, secrets, token_counts, toxicity, url_filter, vectors

QUERIES = {
    "op1_token_rollup": token_counts.op1_token_rollup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_hyperminhash": neardup.op4_hyperminhash,
    "op5_licence_scan": licences.op5_licence_scan,
    "op6_cross_polytope": vectors.op6_cross_polytope,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_html_text": html_text.op8_html_text,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_suffix_dedup": repeats.op13_suffix_dedup,
    "url_aliases": url_filter.url_aliases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_token_rollup": token_counts.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "url_aliases": url_filter.ALIASES,
    "op4_hyperminhash": checks.GROUPS,
    "op5_licence_scan": licences.oracle(),
    "op6_cross_polytope": checks.LINKS,
    "op9_decontamination": checks.LEAKS,
    "op11_fill_in_middle": fill_middle.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
