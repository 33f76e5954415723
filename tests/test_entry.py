"""The driver contract on the smallest tables; skipped where they are missing."""

import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")

CHECKED = [
    "profile_part", "profile_stratified_sample", "fact_emission", "question_filtered_find", "question_edge_case", "ground_facts",
    "dedup_resolution", "validate_eval_set", "source_mixed_headers", "source_eval_json", "diagnose_summary", "eval_sidecar_attach", "eval_batch_answers", "assert_row_results", "score_histogram",
    "score_category_rollup", "chunk_words", "source_merge", "source_page_content", "sink_eval_set", "stream_scores",
]


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(entry.load_queries()[0]) <= set(oracles)


def test_entry(spark):
    import __spark_entry__ as entry

    report = entry.entry(spark)
    assert report.columns == ["category", "questions", "average_score", "pass_count", "pass_rate", "assertions"]
    assert report.count() == 5


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    import __spark_entry__ as entry
    import check_oracle
    import duckdb

    connection = duckdb.connect()
    for table in check_oracle.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = check_oracle.rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(entry.oracle_sql()[name])
    want = check_oracle.rows_of([d[0] for d in result.description], result.fetchall())
    assert got == want
