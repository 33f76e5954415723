"""Query 4: components of all documents whose shingle sets have a similarity of 3/4 or more."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import jaccard
from evalspark.llm.registry import query, table


def components_sql(source: str) -> str:
    """Per row of ``source``: size of its shingle set and its component, as recursive common table expressions."""
    return f"""
    j_rows AS (SELECT *, row_number() OVER () AS j_row,
        list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM {source}),
    j_shingles AS (SELECT DISTINCT j_row, array_to_string(list_slice(w, i, i + 4), ' ') AS s
        FROM j_rows, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
    j_sizes AS (SELECT j_row, count(*) AS n FROM j_shingles GROUP BY j_row),
    j_common AS (SELECT a.j_row AS a, b.j_row AS b, count(*) AS c FROM j_shingles a JOIN j_shingles b ON a.s = b.s AND a.j_row <> b.j_row GROUP BY ALL),
    j_links AS (SELECT a, b FROM j_common JOIN j_sizes x ON x.j_row = a JOIN j_sizes y ON y.j_row = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    j_reach AS (SELECT j_row AS a, j_row AS b FROM j_rows UNION SELECT r.a, l.b FROM j_reach r JOIN j_links l ON r.b = l.a),
    j_components AS (SELECT a AS j_row, min(doc_id) AS component_id, min(b) AS first_row FROM j_reach JOIN j_rows ON j_row = b GROUP BY a),
    j_result AS (SELECT r.*, coalesce(n, 0) AS n_shingles, component_id, first_row
        FROM j_rows r LEFT JOIN j_sizes USING (j_row) JOIN j_components USING (j_row))"""


_SQL = f"WITH RECURSIVE {components_sql('documents')} SELECT doc_id, n_shingles, component_id FROM j_result"


@query("op4_partition_jaccard", _SQL)
def op4_partition_jaccard(spark, sf):
    found = jaccard.similar(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(F.col("row_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
