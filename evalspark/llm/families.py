"""Families of recurring lines, counted by documents and not by neighbours: the line dedup of the pipeline.

Lines are masked and hashed as in ``templates``. A line of eight or more tokens carries, besides itself, one signature
for every three of its four blocks; two lines of a leaf are of one family where they share a signature.

A family recurs where enough different texts hold it, whatever stands around the line, so blocks of several lines recur
like single ones. Copies count once: a text of which less than a quarter (in tokens) is its own, as the rest stands on
lines of other texts as well, counts as the text in which most of that rest stands first. Copies of a document alone
thus don't make a line recur, and they don't hide one that other documents hold too.

A line goes where it carries a recurring signature and its document isn't the first with it; of several signatures the
one in most texts decides. Every dropped line has a like one in a document with a smaller id.

Lines of fewer than ``LEAST_TOKENS`` tokens are what code and headings are made of ("return None", "}", "## Summary"), and recur
everywhere without being boilerplate. They go only beside a longer line that goes, as part of its block.

Defined results: a null text has no lines. Of a signature the first document is the one with the smallest id; rows without an id
are never first, repeated rows of the first document are all first. Blank lines stay. An empty table drops nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.templates import BLOCKS, GENERAL_FROM, LONG_LINE, LONG_RECURS_IN, RECURS_IN, line_keys
from evalspark.session import scratch_path

# A text of which less than one part in so many is its own counts as a copy.
OWN_PART = 4
# Shorter lines go only along with a longer one next to them.
LEAST_TOKENS = 4

_BLOCK_NAMES = [f"b{k}" for k in range(BLOCKS)]
_NARROW = ("pos", "tokens", *_BLOCK_NAMES, "weight", "total")
LINE_SCHEMA = f"doc long, text_key long, leaf long, {', '.join(f'{n} int' for n in _NARROW)}"
_NO_ID = (1 << 63) - 1


def weighed_keys(text: bytes) -> list[tuple]:
    """Per line: leaf, place, token count, block hashes, tokens on all lines of the text like it, tokens of the text."""
    keys = [row[:-1] for row in line_keys(text)]
    total, times = sum(row[1] for row in keys), Counter(row[1:] for row in keys)
    return [(row[2], *row[:2], *row[3:], row[1] * times[row[1:]], total) for row in keys]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row of hashes per line, written once."""

    def rows_of(rows: list[tuple], owner: list[int], ids: pa.Array, keys: pa.Array) -> pa.RecordBatch:
        values = np.array(rows, dtype=np.uint64).view(np.int64)
        columns = [pa.array(values[:, 0]), *[pa.array(values[:, k + 1].astype(np.int32)) for k in range(len(_NARROW))]]
        at = pa.array(owner)
        return pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), *columns], names=["doc", "text_key", "leaf", *_NARROW])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            rows: list[tuple] = []
            owner: list[int] = []
            for i in range(len(texts)):
                found = weighed_keys(texts[i].as_py() or b"")
                rows += found
                owner += [i] * len(found)
                if len(rows) > 100_000:
                    yield rows_of(rows, owner, ids, keys)
                    rows, owner = [], []
            if rows:
                yield rows_of(rows, owner, ids, keys)

    whole = F.col(f"`{text}`")
    lines = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(whole).alias("text_key"), whole.cast("binary").alias("t")
    ).mapInArrow(read, LINE_SCHEMA)
    path = scratch_path(docs.sparkSession, "lines")
    lines.write.parquet(path)
    return docs.sparkSession.read.parquet(path).withColumn("line", F.xxhash64("leaf", *_BLOCK_NAMES))


def _signatures():
    """The line itself and, where it is long enough, its sets of three blocks."""
    some = [F.xxhash64("leaf", F.lit(k), *[b for b in _BLOCK_NAMES if b != f"b{k}"]) for k in range(BLOCKS)]
    return F.when(F.col("tokens") >= GENERAL_FROM, F.array("line", *some)).otherwise(F.array("line"))


def _counted_as(by_text: DataFrame) -> DataFrame:
    """``(text_key, counted)`` of the texts that count as another one."""
    shared = by_text.groupBy("line").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("first", "text_key")).alias("f"))
    shared = shared.filter("texts > 1").select("line", F.col("f.text_key").alias("source"))
    parts = by_text.join(shared, "line").groupBy("text_key", "source").agg(F.sum("weight").alias("w"), F.max("total").alias("total"))
    texts = parts.groupBy("text_key").agg(
        F.sum("w").alias("w"), F.max("total").alias("total"), F.max_by("source", F.struct("w", "source")).alias("counted")
    )
    return texts.filter(OWN_PART * (F.col("total") - F.col("w")) < F.col("total")).select("text_key", "counted")


def recurring_families(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_key, dropped)``: places of the lines to drop, for the texts that lose any."""
    lines = _lines(docs, key, text)
    shared = lines.groupBy("leaf").agg(F.min("text_key").alias("x"), F.max("text_key").alias("y")).filter("x != y")
    rows = lines.join(shared.select("leaf"), "leaf", "left_semi")

    by_text = rows.groupBy("line", "leaf", "tokens", *_BLOCK_NAMES, "text_key").agg(
        F.min(F.coalesce("doc", F.lit(_NO_ID))).alias("first"), F.max("weight").alias("weight"), F.max("total").alias("total")
    )
    held = by_text.join(_counted_as(by_text), "text_key", "left").withColumn("counted", F.coalesce("counted", "text_key"))
    counts = (
        held.select("tokens", "counted", "first", F.explode(_signatures()).alias("signature"))
        .groupBy("signature", "tokens", "counted")
        .agg(F.min("first").alias("first"))
        .groupBy("signature", "tokens")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
    )
    need = F.when(F.col("tokens") >= LONG_LINE, LONG_RECURS_IN).otherwise(RECURS_IN)
    recurring = counts.filter(F.col("texts") >= need).select("signature", "texts", "first")

    kinds = by_text.select("line", "leaf", "tokens", *_BLOCK_NAMES).distinct()
    kinds = kinds.select("line", F.explode(_signatures()).alias("signature"))
    order = F.struct("texts", (F.col("signature") == F.col("line")).alias("own"), "signature")
    going = kinds.join(recurring, "signature").groupBy("line").agg(F.max_by("first", order).alias("first"))
    long = F.col("tokens") >= LEAST_TOKENS
    places = (
        rows.select("line", "doc", "text_key", F.col("pos").cast("long").alias("pos"), "tokens")
        .join(going, "line")
        .filter(F.col("doc").isNull() | (F.col("doc") != F.col("first")))
        .groupBy("doc", "text_key")
        .agg(F.collect_set(F.when(long, F.col("pos"))).alias("long"), F.collect_set(F.when(~long, F.col("pos"))).alias("short"))
    )
    beside = F.filter("short", lambda p: F.array_contains("long", p - 1) | F.array_contains("long", p + 1))
    return places.filter(F.size("long") > 0).select("doc", "text_key", F.concat("long", beside).alias("dropped"))
