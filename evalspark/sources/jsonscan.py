"""JSON documents of any size cut into records on all cores.

The text reader splits files at every ``}``, so a piece is small whatever the document. What a piece does to the parser's state
is a small function: it flips "inside a string" if it holds an odd number of quotes, and moves the depth by one amount if
it starts outside a string and by another if it starts inside. Both are known without the text before. Composed over
the pieces of a split, and over the splits of a file (a table of one row per split), they give every piece its true state; a record ends where the depth
is back at that of the document's elements. Escapes never cross a piece, as JSON has no escaped brace.

A file holds an array of objects, one object, or objects on lines of their own. All work is done by expressions and
windows per split; a record that spans pieces or splits is put together by its number.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.session import scratch_path

WRONG_FORM = "JSON file must contain an array of objects, a single object, or one object per line"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _depth_change(text: Column) -> Column:
    """What brackets outside strings do to the depth; ``text`` starts outside one."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', "")
    return _count(bare, "{[") - _count(bare, "}]")


def _pieces(reader: DataFrameReader, paths: Sequence[str]) -> DataFrame:
    """Pieces with their state functions: ``quotes``, and the change of depth from outside and from inside a string."""
    scan = reader.option("lineSep", "}").text(list(paths))
    rows = scan.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
    )
    plain = rows.withColumn("_plain", F.regexp_replace("value", r"\\.", ""))
    inside = F.regexp_replace("_plain", '^[^"]*("|$)', "")
    closed = F.col("quotes") % 2
    # The brace that ends the piece counts where it stands outside a string.
    return (
        plain.withColumn("quotes", _count(F.col("_plain"), '"'))
        .withColumn("from_outside", _depth_change(F.col("_plain")) - (1 - closed))
        .withColumn("from_inside", _depth_change(inside) - closed)
        .drop("_plain")
    )


def _in_split(pieces: DataFrame) -> DataFrame:
    """State functions of what stands before each piece in its split: whether it flips the string, and both changes of depth."""
    before = Window.partitionBy("path", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("flip") == 0
    return (
        pieces.withColumn("flip", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
        .withColumn("step_outside", F.when(same, F.col("from_outside")).otherwise(F.col("from_inside")))
        .withColumn("step_inside", F.when(same, F.col("from_inside")).otherwise(F.col("from_outside")))
        .withColumn("past_outside", F.coalesce(F.sum("step_outside").over(before), F.lit(0)))
        .withColumn("past_inside", F.coalesce(F.sum("step_inside").over(before), F.lit(0)))
    )


def _split_starts(pieces: DataFrame) -> DataFrame:
    """Per split the state it starts in, and what the file's records are: ``base`` is the depth between them."""
    narrow = pieces.select(
        "path", "block", "mid", "quotes", "from_outside", "from_inside", "file_size",
        F.octet_length("value").alias("bytes"), F.regexp_extract("value", r"^\s*(\S)", 1).alias("opening"),
    )
    splits = _in_split(narrow).groupBy("path", "block").agg(
        (F.sum("quotes") % 2).alias("flips"),
        F.sum("step_outside").alias("all_outside"),
        F.sum("step_inside").alias("all_inside"),
        F.min_by("opening", "mid").alias("opening"),
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("pieces"),
        F.first("file_size").alias("file_size"),
    )
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    return (
        splits.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
        .withColumn("change", F.when(F.col("inside") == 0, F.col("all_outside")).otherwise(F.col("all_inside")))
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        .withColumn("opening", F.min_by("opening", "block").over(whole))
        .withColumn("base", (F.col("opening") == "[").cast("int"))
        # Every piece but the last ended in a brace; the file's size tells whether the last one did.
        .withColumn("braces", F.first("file_size").over(whole) - F.sum("bytes").over(whole))
        .withColumn("in_file", F.sum("pieces").over(whole))
        .select("path", "block", "inside", "depth", "base", "opening", (F.col("braces") >= F.col("in_file")).alias("ends_in_brace"))
    )


def json_records(spark: SparkSession, paths: Sequence[str], reader: DataFrameReader | None = None) -> DataFrame:
    """``path``, ``pos``, ``text``: the records of JSON files in file order, with ``pos`` from 0 in each file.

    Fails where a file holds something else than an array of objects, one object, or one object per line, or breaks off.
    ``reader`` holds options on which files to read.
    """
    reader = reader or spark.read
    starts = _split_starts(_pieces(reader, paths))
    pieces = _in_split(_pieces(reader, paths).join(starts, ["path", "block"]))
    outside = F.col("inside") == 0
    stated = (
        pieces.withColumn("at", F.col("depth") + F.when(outside, F.col("past_outside")).otherwise(F.col("past_inside")))
        .withColumn("after", F.col("at") + F.when(outside, F.col("step_outside")).otherwise(F.col("step_inside")))
        .withColumn("in_string", (F.col("inside") + F.col("flip") + F.col("quotes")) % 2 == 1)
        .withColumn("ends", ~F.col("in_string") & (F.col("after") == F.col("base")))
    )
    order = Window.partitionBy("path", "block").orderBy("mid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A piece that ends a record right after one that ended another is a whole record; at the start of a split that isn't known.
    numbered = (
        stated.withColumn("in_block", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0)))
        .withColumn("single", F.col("ends") & F.lag("ends", 1, False).over(order))
        .select("path", "block", "mid", "value", "in_block", "ends", "single", "base", "ends_in_brace")
    )
    path = scratch_path(spark, "json-pieces")
    numbered.write.parquet(path)
    written = spark.read.parquet(path)

    counts = written.groupBy("path", "block").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("path", "block", offset.alias("offset"))
    placed = written.join(offsets, ["path", "block"]).withColumn("pos", F.col("offset") + F.col("in_block"))
    about = ["ends", "base", "ends_in_brace"]
    # Only records of more than one piece are gathered; the pieces before an end share its number.
    parts = placed.filter(~F.col("single")).groupBy("path", "pos").agg(
        F.sort_array(F.collect_list(F.struct("block", "mid", "value"))).alias("parts"),
        F.max("ends").alias("ends"), F.first("base").alias("base"), F.first("ends_in_brace").alias("ends_in_brace"),
    )
    gathered = parts.select("path", "pos", F.array_join(F.transform("parts", lambda p: p.value), "}").alias("text"), *about)
    whole = placed.filter("single").select("path", "pos", F.col("value").alias("text"), *about).unionByName(gathered)
    out = scratch_path(spark, "json-records")
    # What stands before a record is its separator.
    lead = F.regexp_extract("text", r"^([\s,\[]*)", 1)
    whole.select(
        "path", "pos", *about,
        F.when(F.col("ends"), lead).otherwise(F.col("text")).alias("lead"),
        F.when(F.col("ends"), F.concat(F.expr(r"regexp_replace(text, '^[\\s,\\[]+', '')"), F.lit("}"))).alias("text"),
    ).repartitionByRange("path", "pos").sortWithinPartitions("path", "pos").write.parquet(out)
    # Read back, rows stand in file order.
    records = spark.read.parquet(out)
    if not records.filter(~_well_formed()).isEmpty():
        raise ValueError(WRONG_FORM)
    _check_ends(records)
    return records.filter("ends").select("path", "pos", "text")


def _well_formed() -> Column:
    """Whether a record follows the one before it as it must, and what follows the last one is the document's end."""
    array, first, ends = F.col("base") == 1, F.col("pos") == 0, F.col("ends")
    lead = F.col("lead")
    separator = (
        F.when(array & first, lead.rlike(r"^\s*\[\s*$"))
        .when(array, lead.rlike(r"^\s*,\s*$"))
        .when(first, lead.rlike(r"^\s*$"))
        .otherwise(lead.rlike(r"^\s*\n\s*$"))
    )
    rest = (
        F.when(array & first, lead.rlike(r"^\s*\[\s*\]\s*$")).when(array, lead.rlike(r"^\s*\]\s*$")).otherwise(lead.rlike(r"^\s*$"))
    )
    return F.coalesce(F.when(ends, separator & F.col("text").startswith("{")).otherwise(rest), F.lit(False))


def _check_ends(records: DataFrame) -> None:
    """An array must close, and no brace may be taken for granted at the end of a file."""
    last = records.groupBy("path").agg(
        F.max_by("ends", "pos").alias("ends"), F.first("base").alias("base"), F.first("ends_in_brace").alias("brace")
    )
    closed = F.when(F.col("ends"), (F.col("base") == 0) & F.col("brace")).otherwise(~F.col("brace"))
    if not last.filter(~closed).isEmpty():
        raise ValueError(WRONG_FORM)


def parse_records(records: DataFrame) -> DataFrame:
    """Records as columns, with ``_path`` and ``_pos``; keys are united over all of them."""
    spark = records.sparkSession
    texts = records.select("text")._jdf
    as_text = getattr(texts, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(as_text).schema().json()))
    if "_corrupt_record" in schema.names:
        raise ValueError(WRONG_FORM)
    row = F.from_json("text", schema, {"mode": "FAILFAST"}).alias("_row")
    fields = [F.col(f"_row.`{n}`").alias(n) for n in schema.names]
    return records.select(row, "path", "pos").select(*fields, F.col("path").alias("_path"), F.col("pos").alias("_pos"))
