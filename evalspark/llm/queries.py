"""Load the queries of this subpackage: one per operator, and the corpus pipeline."""

from __future__ import annotations

import importlib

MODULES = (
    "quality_query",
    "sharding_query",
    "decontamination_query",
    "jaccard_query",
    "secrets_query",
    "licenses_query",
    "templates_query",
    "warc_query",
    "language_query",
    "packing_query",
    "whitening_query",
    "digest_merge_query",
    "alignment_query",
    "pipeline_query",
)


def load_queries():
    """``(queries, oracles)``, each module imported once."""
    from evalspark.llm import registry

    for name in MODULES:
        importlib.import_module(f"evalspark.llm.{name}")
    return registry.QUERIES, registry.ORACLES
