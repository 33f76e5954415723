"""Query 1: quality rules over all documents."""

from __future__ import annotations

from evalspark.llm import quality
from evalspark.llm.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


def verdict_sql(source: str) -> str:
    """Metrics and verdict of every row of ``source`` (which needs ``doc_id`` and ``text``), as common table expressions."""
    failed = []
    for rule in (*quality.BASE_RULES, *quality.RULES):
        tests = [f"{rule.value} < {rule.lower}"] if rule.lower is not None else []
        tests += [f"{rule.value} > {rule.upper}"] if rule.upper is not None else []
        test = " OR ".join(tests).replace("/", "/ 1.0 /")
        failed.append(f"coalesce(({test}) AND n_words >= {rule.from_words}, false)")
    base = " OR ".join(failed[: len(quality.BASE_RULES)])
    return rf"""
    q_rows AS (SELECT *, row_number() OVER () AS q_row, coalesce(text, '') AS q_text FROM {source}),
    q_words AS (SELECT q_row, list_filter(string_split_regex(q_text, '[ \t-\r]+'), lambda x: x <> '') AS w,
        list_filter(string_split(q_text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM q_rows),
    q_windows AS (SELECT q_row, i, count(*) OVER (PARTITION BY q_row, list_slice(w, i, i + 4)) AS c
        FROM q_words, unnest(range(1, len(w) - 3)) AS u(i)),
    q_repeat AS (SELECT q_row, count(DISTINCT i + k) AS n FROM q_windows, unnest(range(0, 5)) AS v(k) WHERE c > 1 GROUP BY q_row),
    q_metrics AS (SELECT r.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(q_text, '{quality.SYMBOLS}')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words,
        len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
        len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•] '))) AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*\z'))) AS n_ellipsis_lines
        FROM q_rows r JOIN q_words USING (q_row) LEFT JOIN q_repeat p USING (q_row)),
    q_verdict AS (SELECT *, {base} AS base_failed, NOT ({" OR ".join(failed)}) AS kept FROM q_metrics)"""


_COLUMNS = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"


@query("op1_quality_rules", f"WITH {verdict_sql('documents')} SELECT {_COLUMNS} FROM q_verdict")
def op1_quality_rules(spark, sf):
    return quality.judge(table(spark, sf, "documents").select("doc_id", "text")).select(*_COLUMNS.split(", "))
