"""Registered queries of the package: importing an operator module registers it."""

from __future__ import annotations

from creditloom.llm import (
    chat_format,
    common,
    conversation_repair,
    decontamination,
    language_id,
    license_scan,
    packing,
    periodic_runs,
    quality,
    sentence_pieces,
    simhash_dedup,
    substring_dedup,
    token_counts,
    vector_search,
)

__all__ = ["chat_format", "common", "conversation_repair", "decontamination", "language_id", "license_scan", "packing", "periodic_runs", "quality", "sentence_pieces", "simhash_dedup", "substring_dedup", "token_counts", "vector_search"]

QUERIES = common.QUERIES
ORACLES = common.ORACLES
