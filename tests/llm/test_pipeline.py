"""The pipeline over the smallest tables, stage by stage."""

import os

import pytest

import corpus_pipeline
from evalspark.llm import decontamination, jaccard, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = results[name] = spark.read.parquet(str(tmp_path / name))
    ids = {n: [r[0] for r in df.select("doc_id").distinct().collect()] for n, df in results.items()}
    order = [n for n, _ in corpus_pipeline.STAGES]
    for before, after in zip(order, order[1:]):
        assert set(ids[after]) <= set(ids[before])
    assert all(results[n].columns == columns for n in order[:-1])
    assert quality.judge(results["quality_rules"]).filter("NOT kept").count() == 0
    kept = jaccard.similar(results["near_duplicates"])
    assert kept.groupBy("component_id").count().filter("count > 1").count() == 0
    clean = results["benchmark_decontamination"]
    assert decontamination.decontaminate(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0
    assert set(ids["packing"]) == set(ids["benchmark_decontamination"])


def test_near_duplicates_takes_few_jobs(spark):
    """Plans of many jobs fill the driver, whatever the rows are."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 3 * i] + [f"x{i}", f"y{i}"] + base[3 * i + 2 :]), "a") for i in range(60)]
    rows += [(1000 + i, " ".join(f"u{i}n{k}" for k in range(150)), "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    spark.sparkContext.setJobGroup("near", "jobs of one run")
    try:
        kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near")) < 90
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == [0, *range(1000, 1040)]
