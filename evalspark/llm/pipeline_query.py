"""The corpus pipeline as a query; tokenizers have no SQL form, so its stages are tested one by one."""

from __future__ import annotations

import corpus_pipeline
from evalspark.llm.registry import query


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
