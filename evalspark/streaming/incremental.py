"""Incremental scoring: the batch chain on a stream of evaluation rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evalspark.operators.assertions import evaluate_assertions
from evalspark.operators.preparation import score_answers
from evalspark.operators.scoring import PASS_THRESHOLD, category_breakdown


def first_deliveries(rows: DataFrame, key: str | list[str], event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """Rows of a stream whose ``key`` no earlier row had, over all runs of its checkpoint.

    With ``event_time`` and ``horizon`` (such as "30 days") a key is remembered until the latest time seen is that much later, so
    state holds the keys of one horizon; a row that comes later than this is left out. Without them every
    key is remembered.
    """
    keys = [key] if isinstance(key, str) else key
    if event_time is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def score_stream(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str,
    score: Callable[[DataFrame], DataFrame] = score_answers, max_files: int | None = None,
    key: str | list[str] | None = None, event_time: str | None = None, horizon: str | None = None,
) -> DataFrame:
    """Score the files of ``source`` that no earlier run has seen and append them to ``target``.

    The checkpoint is the resume point: a restarted run goes on after the last committed batch, and no file is scored twice.
    With ``key`` no row is either: one that is delivered again, in the same file or a later one, is left out before it is
    scored (``first_deliveries``). The other steps are stateless, so they run unchanged on the stream.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(source)
    if key is not None:
        rows = first_deliveries(rows, key, event_time, horizon)
    scored = evaluate_assertions(score(rows))
    run = (
        scored.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(target)


def category_stream(
    spark: SparkSession, scored: str, schema: T.StructType, target: str, checkpoint: str, threshold: int = PASS_THRESHOLD
) -> DataFrame:
    """Keep the per-category table up to date from a growing folder of scored rows.

    Complete mode with one state row per category; each batch replaces the small result table.
    """
    rows = spark.readStream.schema(schema).parquet(scored)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    run = (
        category_breakdown(rows, threshold)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(target)
