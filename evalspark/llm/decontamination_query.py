"""Query 3: words of all documents inside windows of benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import decontamination
from evalspark.llm.registry import query, table

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def hits_sql(source: str) -> str:
    """Per row of ``source``: words, hit words and item ids, as common table expressions ending in ``h_rows``."""
    return f"""
    h_docs AS (SELECT *, row_number() OVER () AS h_row, coalesce({_WORDS}, []) AS w FROM {source}),
    h_items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    h_windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS s
        FROM h_items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
    h_sizes AS (SELECT DISTINCT size FROM h_windows),
    h_places AS (SELECT h_row, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
        FROM h_docs, h_sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
    h_hits AS (SELECT h_row, i, p.size, item_id FROM h_places p JOIN h_windows v ON p.s = v.s AND p.size = v.size),
    h_words AS (SELECT h_row, count(DISTINCT i + k) AS n FROM h_hits, unnest(range(0, size)) AS v(k) GROUP BY h_row),
    h_ids AS (SELECT h_row, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM h_hits GROUP BY h_row),
    h_rows AS (SELECT d.*, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(ids, []) AS ids
        FROM h_docs d LEFT JOIN h_words USING (h_row) LEFT JOIN h_ids USING (h_row))"""


_SQL = f"""WITH {hits_sql('documents')}
SELECT doc_id, n_words, n_hit, len(ids) AS n_items, sha256(array_to_string(ids, ',')) AS items_sha256, n_hit > 0 AS contaminated FROM h_rows"""


@query("op3_prefix_decontamination", _SQL)
def op3_prefix_decontamination(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
