"""Query 7: all documents without the lines of recurring templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import templates as t
from evalspark.llm.registry import query, table


def lines_sql(source: str) -> str:
    """Per row of ``source``: lines, dropped lines and the remaining text, ending in ``t_result``."""
    tail = [f"array_to_string(list_slice(w, 4 + (len(w) - 3) * {k} // 4, 3 + (len(w) - 3) * {k + 1} // 4), ' ')" for k in range(4)]
    blocks = ", ".join(f"CASE WHEN len(w) > 3 THEN {x} ELSE '' END AS b{k}" for k, x in enumerate(tail))
    template = "leaf, tokens, b0, b1, b2, b3"
    same = " + ".join(f"(CASE WHEN p.b{k} = h.b{k} THEN 1 ELSE 0 END)" for k in range(4))
    return f"""
    t_docs AS (SELECT *, row_number() OVER () AS t_row, string_split(text, chr(10)) AS l FROM {source}),
    t_split AS (SELECT t_row, doc_id, text, i - 1 AS pos, list_transform(list_filter(string_split_regex(l[i], '[ \\t-\\r]+'), lambda x: x <> ''),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM t_docs, unnest(range(1, len(l) + 1)) AS u(i)),
    t_keys AS (SELECT t_row, doc_id, text, pos, len(w) AS tokens, array_to_string(list_slice(w, 1, 3), ' ') AS leaf, {blocks},
        len(w) || '|' || array_to_string(w, ' ') AS whole FROM t_split WHERE len(w) > 0),
    t_lines AS (SELECT *, coalesce(lag(whole) OVER o, '') || chr(10) || coalesce(lead(whole) OVER o, '') AS surrounding FROM t_keys WINDOW o AS (PARTITION BY t_row ORDER BY pos)),
    t_templates AS (SELECT {template}, count(DISTINCT text) AS texts, min(doc_id) AS d, arg_min(pos, doc_id * 1000000 + pos) AS p FROM t_lines GROUP BY ALL),
    t_hubs AS (SELECT * FROM t_templates QUALIFY row_number() OVER (PARTITION BY leaf, tokens ORDER BY texts DESC, d, p) = 1),
    t_named AS (SELECT p.*, CASE WHEN p.tokens >= {t.GENERAL_FROM} AND {same} >= {t.SHARED_BLOCKS} THEN [h.b0, h.b1, h.b2, h.b3] ELSE [p.b0, p.b1, p.b2, p.b3] END AS g
        FROM t_templates p JOIN t_hubs h ON p.leaf = h.leaf AND p.tokens = h.tokens),
    t_grouped AS (SELECT l.*, g FROM t_lines l JOIN t_named USING ({template})),
    t_recurring AS (SELECT leaf, tokens, g, min(doc_id) AS first_doc FROM t_grouped GROUP BY ALL
        HAVING least(count(DISTINCT text), count(DISTINCT surrounding)) >= CASE WHEN tokens >= {t.LONG_LINE} THEN {t.LONG_RECURS_IN} ELSE {t.RECURS_IN} END
        AND 2 * count(DISTINCT surrounding) >= count(DISTINCT text)),
    t_dropped AS (SELECT t_row, list(pos) AS dropped FROM t_grouped JOIN t_recurring USING (leaf, tokens, g) WHERE doc_id <> first_doc GROUP BY t_row),
    t_result AS (SELECT d.*, coalesce(len(l), 0) AS n_lines, coalesce(len(dropped), 0) AS n_dropped, CASE WHEN dropped IS NULL THEN text
        ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(dropped, i - 1)), chr(10)) END AS rest FROM t_docs d LEFT JOIN t_dropped USING (t_row))"""


@query("op7_template_lines", f"WITH {lines_sql('documents')} SELECT doc_id, n_lines, n_dropped, rest AS text FROM t_result")
def op7_template_lines(spark, sf):
    found = t.drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")
