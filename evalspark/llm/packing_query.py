"""Query 10: all documents packed. Tokenizers have no SQL form; tests rebuild every document from its pieces."""

from __future__ import annotations

from evalspark.llm import packing
from evalspark.llm.registry import query, table


@query("op10_harmonic_packing")
def op10_harmonic_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))
