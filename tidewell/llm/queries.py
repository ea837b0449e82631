"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, clusters, decontaminate, langid, licenses, mixing, pii, secrets, simhash, substrings, suffixes, tokenstore, topk
from .sql import ORACLES

QUERIES = {
    "op1_topk_search": topk.op1_topk_search,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_language_id": langid.op3_language_id,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_token_store": tokenstore.op6_token_store,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_personal_data": pii.op10_personal_data,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_centroid_clusters": clusters.op12_centroid_clusters,
    "op13_suffix_dedup": suffixes.op13_suffix_dedup,
}

__all__ = ["ORACLES", "QUERIES"]
