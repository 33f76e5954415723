"""Query 9: the language of every page. The model has no SQL form; tests measure held-out accuracy."""

from __future__ import annotations

from evalspark.llm import language
from evalspark.llm.registry import query, table


@query("op9_language_fusion")
def op9_language_fusion(spark, sf):
    return language.identify(table(spark, sf, "pages"), language.fit(table(spark, sf, "documents")))
