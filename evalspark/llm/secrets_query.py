"""Query 5: secrets in all documents. Offsets of regular expressions have no SQL form; tests use brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import secrets
from evalspark.llm.registry import query, table


@query("op5_structural_secrets")
def op5_structural_secrets(spark, sf):
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[secrets.counted(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.rendered(spans, secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.rendered(spans).alias("spans"),
    )
