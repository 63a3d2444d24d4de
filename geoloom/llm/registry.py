"""The queries of this subpackage, by name, and their oracle SQL."""

from __future__ import annotations

import importlib

#: Modules that define QUERIES and, where SQL can express them, ORACLES.
MODULES = (
    "fingerprints",
    "simhash",
    "transport_stream",
    "mixing",
    "bpe",
    "substrings",
    "language_id",
    "quality",
    "license_scan",
    "html_consensus",
    "ranked_search",
    "periodic_runs",
    "suffix_dedup",
)


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    import corpus_pipeline

    found = {k: f for m in _modules() for k, f in m.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {k: s for m in _modules() for k, s in getattr(m, "ORACLES", {}).items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
