"""Query 13: tokens of all documents aligned. Tokenizers have no SQL form; tests count every link anew."""

from __future__ import annotations

from evalspark.llm import alignment
from evalspark.llm.registry import query, table


@query("op13_identity_alignment")
def op13_identity_alignment(spark, sf):
    return alignment.align(table(spark, sf, "documents"))
