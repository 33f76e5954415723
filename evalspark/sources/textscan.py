"""Text files of any size cut into chunks of sections on all cores.

Files are read line by line, so scans split them. A section starts at a line behind blank ones or at a heading; both are
known from the line and the one before it. Splits hand on what their last line was and how many sections they hold, one small row each.

Which section opens a chunk depends on how full the chunk before is, from the start of the file on. For a group of
sections, though, that is a small function: from how full the chunk is before the group (``limit`` + 2 cases) to how full
the last one is behind it, and how many chunks opened. Those functions are composed over the groups of a file, in levels
of ``FAN`` groups each, so no task holds more than that of a file. The rule is that of ``chunking.chunk_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.text import trim_ws, word_count
from evalspark.operators.chunking import CHUNK_CHARS
from evalspark.session import scratch_path
from evalspark.sources.rowindex import with_offsets

#: Sections in a group, and groups whose functions one task composes.
GROUP = 4096
FAN = 512
GAP = 2  # characters between the sections of a chunk

_HEADING = r"(?m)(?=^#{1,3}(?:\s|\z))"
_HEADING_AT_END = r"(?m)(?=^#{1,3}\s)"


def _lines(reader: DataFrameReader, paths: Sequence[str]) -> DataFrame:
    return reader.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """Per split: whether the line before it is blank, or the first of the file, and whether the file's last line lies in it unended."""
    found = lines.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("value").cast("long")).alias("bytes"),
        F.max_by(F.col("value") == "", "mid").alias("ends_blank"),
        F.first("file_size").alias("file_size"),
    )
    order, whole = Window.partitionBy("path").orderBy("block"), Window.partitionBy("path")
    # Of the bytes beside the lines' own, three may be a mark of the byte order; the rest are line breaks.
    breaks = F.first("file_size").over(whole) - F.sum("bytes").over(whole) - F.sum("n").over(whole)
    open_end = ~breaks.isin(0, 3) & (F.col("block") == F.max("block").over(whole))
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.select(
        "path", "block",
        F.lag("ends_blank").over(order).alias("blank_before"),
        F.coalesce(before, F.lit(0)).alias("lines_before"),
        F.when(open_end, F.sum("n").over(whole) - 1).alias("open_line"),
    )


def text_file_sections(spark: SparkSession, paths: Sequence[str], reader: DataFrameReader | None = None) -> DataFrame:
    """``path, section, text``, written once: the sections of text files that aren't blank; ``section`` rises within a file."""
    reader = reader or spark.read
    lines = _lines(reader, paths).drop("file_size").join(_blocks(_lines(reader, paths)), ["path", "block"])
    order = Window.partitionBy("path", "block").orderBy("mid")
    lined = (
        lines.withColumn("number", F.col("lines_before") + F.row_number().over(order) - 1)
        .withColumn("blank_before", F.coalesce(F.lag(F.col("value") == "").over(order), "blank_before", F.lit(False)))
        .withColumn("unended", F.coalesce(F.col("number") == F.col("open_line"), F.lit(False)))
    )
    # One line break at the start of a file is no blank line.
    behind = F.col("blank_before") & (F.col("number") > 1) & (F.col("value") != "")
    parts = F.when(~F.contains("value", F.lit("#")), F.array("value")).otherwise(
        F.when(F.col("unended"), F.split("value", _HEADING_AT_END)).otherwise(F.split("value", _HEADING))
    )
    cut = lined.select("path", "block", "mid", "number", "unended", behind.alias("behind"), parts.alias("parts"))
    pieces = cut.select("*", F.posexplode("parts").alias("part", "piece")).withColumn("closes", F.col("part") == F.size("parts") - 1)
    heading = F.when(F.col("unended") & F.col("closes"), F.col("piece").rlike(r"^#{1,3}\s")).otherwise(F.col("piece").rlike(r"^#{1,3}(?:\s|\z)"))
    starts = (F.col("part") > 0) | F.col("behind") | heading
    inner = Window.partitionBy("path", "block").orderBy("mid", "part")
    numbered = pieces.select(
        "path", "block", "number", "part",
        F.concat("piece", F.when(F.col("closes") & ~F.col("unended"), "\n").otherwise("")).alias("piece"),
        F.sum(starts.cast("long")).over(inner).alias("in_block"),
    )
    written = scratch_path(spark, "text-pieces")
    numbered.write.option("compression", "zstd").parquet(written)
    numbered = spark.read.parquet(written)

    counts = numbered.groupBy("path", "block").agg(F.max("in_block").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    # One row per split: small beside the texts, which therefore stay where they are.
    scan = reader.option("lineSep", "\n").text(list(paths))
    placed = with_offsets(numbered, offsets, ["path", "block"], scan.rdd.getNumPartitions() + len(scan.inputFiles())).withColumn("section", F.col("offset") + F.col("in_block"))
    joined = placed.groupBy("path", "section").agg(F.sort_array(F.collect_list(F.struct("number", "part", "piece"))).alias("pieces"))
    raw = F.array_join(F.transform("pieces", lambda p: p.piece), "")
    sections = joined.select("path", "section", F.regexp_replace(raw, r"\n{2,}\z", "").alias("text"))
    out = scratch_path(spark, "text-sections")
    sections.filter(trim_ws(F.col("text")) != "").write.option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


class Packing:
    """How sections of the given lengths fall into chunks, for every fill of the chunk before them.

    A fill counts the characters of the open chunk, each section with the gap behind it; 0 is the start of a file. All fills
    above the limit are alike, as any next section then opens a chunk.
    """

    def __init__(self, lengths: np.ndarray, limit: int):
        self.limit = limit
        self.size = len(lengths)
        self.past = np.concatenate(([0], np.cumsum(lengths.astype(np.int64) + GAP)))
        self.ends = self.past[1:] - GAP
        # A chunk that starts at a section reaches to the first that would pass the limit, whatever stood before it.
        following = np.searchsorted(self.ends, limit + self.past[:-1], side="right")
        self.following = np.maximum(following, np.arange(1, self.size + 1))

    def first(self, fill) -> np.ndarray:
        """The first section that opens a chunk; as many as there are sections where none does."""
        fill = np.asarray(fill, dtype=np.int64)
        return np.where(fill > 0, np.searchsorted(self.ends, self.limit - fill, side="right"), 0)

    def function(self) -> tuple[np.ndarray, np.ndarray]:
        """``(fill behind the sections, chunks opened)`` for each fill before them."""
        opened, fill = np.zeros(self.size + 1, dtype=np.int64), np.zeros(self.size + 1, dtype=np.int64)
        for at in range(self.size - 1, -1, -1):
            goes_on = self.following[at]
            opened[at] = 1 + opened[goes_on]
            fill[at] = fill[goes_on] if goes_on < self.size else self.past[-1] - self.past[at]
        before = np.arange(self.limit + 2)
        first = self.first(before)
        behind = np.where(first < self.size, fill[first], before + self.past[-1])
        return np.minimum(behind, self.limit + 1), opened[first]

    def chunks(self, fill: int) -> np.ndarray:
        """How many chunks have opened at each section, itself included."""
        opens = np.zeros(self.size, dtype=np.int64)
        at = int(self.first(fill))
        while at < self.size:
            opens[at] = 1
            at = int(self.following[at])
        return np.cumsum(opens)


_FUNCTION = "path string, g long, fills array<int>, opened array<long>"


def _composed(functions: DataFrame) -> DataFrame:
    """One function for each ``FAN`` groups of a file."""

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fills = opened = None
        for then, more in rows.sort_values("g")[["fills", "opened"]].itertuples(index=False):
            then, more = np.asarray(then), np.asarray(more)
            fills, opened = (then, more) if fills is None else (then[fills], opened + more[fills])
        return pd.DataFrame({"path": [key[0]], "g": [key[1]], "fills": [fills], "opened": [opened]})

    return functions.groupBy("path", F.expr(f"g div {FAN}").alias("upper")).applyInPandas(compose, _FUNCTION)


def _states(functions: DataFrame) -> DataFrame:
    """``path, g, fill, before``: how full the chunk is before each group of a file, and how many chunks opened there."""
    spark = functions.sparkSession
    if (functions.agg(F.max("g")).first()[0] or 0) < FAN:
        upper = functions.select("path", F.lit(0).cast("long").alias("upper"), F.lit(0).alias("fill"), F.lit(0).cast("long").alias("before")).distinct()
    else:
        path = scratch_path(spark, "text-functions")
        _composed(functions).write.parquet(path)
        upper = _states(spark.read.parquet(path)).withColumnRenamed("g", "upper")

    def spread(key: tuple, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        fill, before, out = int(start["fill"].iloc[0]), int(start["before"].iloc[0]), []
        for g, fills, opened in rows.sort_values("g")[["g", "fills", "opened"]].itertuples(index=False):
            out.append((key[0], g, fill, before))
            fill, before = int(fills[fill]), before + int(opened[fill])
        return pd.DataFrame(out, columns=["path", "g", "fill", "before"])

    groups = functions.withColumn("upper", F.expr(f"g div {FAN}")).groupBy("path", "upper")
    return groups.cogroup(upper.groupBy("path", "upper")).applyInPandas(spread, "path string, g long, fill int, before long")


def chunk_text_files(spark: SparkSession, paths: Sequence[str], reader: DataFrameReader | None = None, limit: int = CHUNK_CHARS) -> DataFrame:
    """``path, chunk_number (from 1), content, word_count`` of text files, as ``chunking.chunk_sections`` makes them of whole texts."""
    sections = text_file_sections(spark, paths, reader)

    @F.pandas_udf("struct<fills: array<int>, opened: array<long>>")
    def function(lengths: pd.Series) -> pd.DataFrame:
        found = [Packing(np.asarray(x), limit).function() for x in lengths]
        return pd.DataFrame({"fills": [x[0].astype(np.int32) for x in found], "opened": [x[1] for x in found]})

    @F.pandas_udf("array<long>")
    def chunks(lengths: pd.Series, fill: pd.Series) -> pd.Series:
        return pd.Series([Packing(np.asarray(x), limit).chunks(s) for x, s in zip(lengths, fill)])

    sized = sections.select("path", "section", F.expr(f"section div {GROUP}").alias("g"), F.length("text").alias("n"))
    groups = sized.groupBy("path", "g").agg(F.sort_array(F.collect_list(F.struct("section", "n"))).alias("sized"))
    lengths = F.transform("sized", lambda x: x.n)
    path = scratch_path(spark, "text-groups")
    groups.withColumn("f", function(lengths)).select("path", "g", "sized", "f.*").write.parquet(path)
    groups = spark.read.parquet(path)
    states = _states(groups.select("path", "g", "fills", "opened"))
    opened = groups.select("path", "g", "sized").join(states, ["path", "g"]).withColumn("opened", chunks(lengths, "fill"))
    placed = opened.select("path", "before", F.explode(F.arrays_zip(F.transform("sized", lambda x: x.section).alias("section"), "opened")).alias("x"))
    numbers = placed.select("path", F.col("x.section").alias("section"), (F.col("before") + F.col("x.opened")).cast("int").alias("chunk_number"))
    gathered = sections.join(numbers, ["path", "section"]).groupBy("path", "chunk_number").agg(
        F.sort_array(F.collect_list(F.struct("section", "text"))).alias("parts")
    )
    content = trim_ws(F.array_join(F.transform("parts", lambda x: x.text), "\n\n"))
    return gathered.select("path", "chunk_number", content.alias("content")).withColumn("word_count", word_count(F.col("content")))
