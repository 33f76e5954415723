"""Stable row numbers.

Every order-dependent rule downstream ("first seen", "evenly spaced", row references) uses the
``row_index`` made here once, never the accidental order of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import scratch_path

# One offset per file or split: eight bytes of key and eight of number, about 64 in a hash table. A table of offsets is
# broadcast up to this many bytes; a larger one is joined by shuffle.
BROADCAST_BYTES = 512 << 20
OFFSET_BYTES = 64


def with_offsets(tagged: DataFrame, offsets: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """Join ``offsets`` (one row per ``keys``, ``count`` of them) under a short key instead of paths."""
    short = F.xxhash64(*keys)
    narrow = offsets.select(short.alias("_key"), *[c for c in offsets.columns if c not in keys])
    if count * OFFSET_BYTES <= BROADCAST_BYTES:
        narrow = F.broadcast(narrow)
    return tagged.withColumn("_key", short).join(narrow, "_key").drop("_key")


def _offsets(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Exclusive running sum over the small table of counts per file or split."""
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(window), F.lit(0).cast("bigint")))


def with_row_index(scan: DataFrame, name: str = "row_index", source_file: bool = False) -> DataFrame:
    """Number the rows of a Parquet scan by (file path, position in file), without a shuffle.

    The position inside a file comes from the reader; only the row counts per file are aggregated,
    which Spark answers from the footers. ``source_file`` adds the file's base name.
    """
    tagged = scan.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_pos")
    )
    counts = scan.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _offsets(counts, ["_path"]).select("_path", "_offset")
    numbered = with_offsets(tagged, offsets, ["_path"], len(scan.inputFiles())).withColumn(name, F.col("_offset") + F.col("_pos"))
    if source_file:
        numbered = numbered.withColumn("_source_file", F.element_at(F.split("_path", "/"), -1))
    return numbered.drop("_path", "_pos", "_offset")


def with_split_row_index(scan: DataFrame, name: str = "row_index", source_file: bool = False) -> DataFrame:
    """Number the rows of a text-based scan (CSV, JSON, text) by (file path, split start, line order).

    Rows of one split are contiguous in one partition, so the increasing id minus the smallest id of
    the split is the position in it. Again only counts per split are aggregated.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    counts = tagged.groupBy("_path", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_mid").alias("_first")
    )
    offsets = _offsets(counts, ["_path", "_block"]).select("_path", "_block", "_first", "_offset")
    splits = scan.rdd.getNumPartitions() + len(scan.inputFiles())
    numbered = with_offsets(tagged, offsets, ["_path", "_block"], splits).withColumn(
        name, F.col("_offset") + F.col("_mid") - F.col("_first")
    )
    if source_file:
        numbered = numbered.withColumn("_source_file", F.element_at(F.split("_path", "/"), -1))
    return numbered.drop("_path", "_block", "_mid", "_first", "_offset")


def with_row_index_by(df: DataFrame, keys: Sequence[str], name: str = "row_index") -> DataFrame:
    """Number rows in the order of ``keys``, which must be a total order.

    The rows are range-partitioned, sorted and written once to the shared folder; the files are then
    numbered by name and position. Nothing is ever sorted in one task, and a lost executor cannot
    change the numbers because they are read from the written table.
    """
    path = scratch_path(df.sparkSession, "numbered")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
    return with_row_index(df.sparkSession.read.parquet(path), name)


def with_row_reference(df: DataFrame, label: str | None = None, name: str = "row_ref") -> DataFrame:
    """``<file>:row <1-based number>`` from ``row_index``; the file is ``_source_file`` or ``label``."""
    file = F.lit(label) if label is not None else F.col("_source_file")
    return df.withColumn(name, F.concat(file, F.lit(":row "), (F.col("row_index") + 1).cast("string")))
