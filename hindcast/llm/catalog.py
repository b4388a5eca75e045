"""All queries of the pipeline operators."""

from __future__ import annotations

from hindcast.llm import binary_search, chunk_bpe, decontamination, filter_audit, hard_negatives, language_evidence, near_dedup, pitman_yor, prefix_bpe, secret_layers, surrogates, token_counts, warc_archive  # noqa: F401
from hindcast.llm.registry import CHECKS, PLANS, Plan


def queries() -> dict[str, Plan]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
