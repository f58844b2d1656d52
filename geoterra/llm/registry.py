"""The subpackage's queries and the SQL that states their results."""

from __future__ import annotations

from . import context_tree, conversation_repair, decontamination, embedding_dedup, jaccard_join, language_crf, merkle_manifest, packing, quality_fm, suffix_dedup, threshold_search, token_counts, url_trust

MODULES = (token_counts, decontamination, quality_fm, threshold_search, suffix_dedup, jaccard_join, url_trust, packing, context_tree, language_crf, embedding_dedup, conversation_repair, merkle_manifest)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
