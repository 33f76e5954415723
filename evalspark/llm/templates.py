"""Line dedup by a log-template tree of fixed depth.

A line's tokens with a digit are variable fields. The tree branches on the token count, then on the first three tokens;
below a leaf a line's tail is cut into four blocks of positions. The leaf's most frequent line is its template: lines of
eight or more tokens that share three of the four blocks with it belong to it, so one further stretch may vary. Other
lines stand for themselves.

A template recurs where it stands in enough different texts and in enough different surroundings (the lines before and
after it). Copies of a document repeat their surroundings as well, so they don't make a template recur; they are a
matter for near-duplicate detection. Lines of recurring templates are dropped from all documents but the first.

Lines are read once and kept as hashes in the shared scratch folder. Leaves seen in one text only are left out before
anything else is counted, and counts of a common line are formed in two steps, so no task gathers its rows.

Defined results: a null text stays null, an empty one empty. The first document of a template is the one with the
smallest id; rows without an id are never first, repeated rows of the first document are all first. Blank lines stay.
Other columns are not touched. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import scratch_path

LEADING = 3
BLOCKS = 4
SHARED_BLOCKS = 3
GENERAL_FROM = 8
RECURS_IN = 3
# A line of this many tokens isn't repeated by chance.
LONG_LINE, LONG_RECURS_IN = 50, 2
VARIABLE = b"<*>"

_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
_LINE_NAMES = ("pos", "tokens", "leaf", *[f"b{k}" for k in range(BLOCKS)], "surrounding")
LINE_SCHEMA = (
    f"doc long, text_key long, pos int, tokens int, leaf long, {', '.join(f'b{k} int' for k in range(BLOCKS))}, surrounding long"
)
_TEMPLATE = ["leaf", "tokens", *[f"b{k}" for k in range(BLOCKS)]]


def masked(line: bytes) -> list[bytes]:
    tokens = line.split()
    if b"0" in line.translate(_DIGITS):
        return [VARIABLE if b"0" in t.translate(_DIGITS) else t for t in tokens]
    return tokens


def _hash(tokens: list[bytes]) -> int:
    """32 bits suffice for a block, as it is compared within its leaf and along with other blocks."""
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)) & 0xFFFFFFFF if tokens else 0


def line_keys(text: bytes) -> list[tuple]:
    """Per line with a token: place, token count, leaf, hash of each block, hash of the lines around it."""
    out = []
    for pos, line in enumerate(text.split(b"\n")):
        tokens = masked(line)
        count = len(tokens)
        if not count:
            continue
        tail = tokens[LEADING:]
        size = len(tail)
        blocks = [_hash(tail[size * k // BLOCKS : size * (k + 1) // BLOCKS]) for k in range(BLOCKS)]
        leaf = xxhash.xxh3_64_intdigest(b" ".join(tokens[:LEADING]), seed=count)
        out.append((pos, count, leaf, *blocks))
    whole = [0, *[hash_row(row[1:]) for row in out], 0]
    return [(*row, hash_row((whole[i], whole[i + 2]))) for i, row in enumerate(out)]


def hash_row(values: tuple) -> int:
    return xxhash.xxh3_64_intdigest(np.array(values, dtype=np.uint64).tobytes())


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row of hashes per line, written once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            rows: list[tuple] = []
            owner: list[int] = []
            for i in range(len(texts)):
                found = line_keys(texts[i].as_py() or b"")
                rows += found
                owner += [i] * len(found)
                if len(rows) > 100_000:
                    yield _batch(rows, pa.array(owner), ids, keys)
                    rows, owner = [], []
            if rows:
                yield _batch(rows, pa.array(owner), ids, keys)

    whole = F.col(f"`{text}`")
    lines = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(whole).alias("text_key"), whole.cast("binary").alias("t")
    ).mapInArrow(read, LINE_SCHEMA)
    path = scratch_path(docs.sparkSession, "lines")
    lines.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _batch(rows: list[tuple], owner: pa.Array, ids: pa.Array, keys: pa.Array) -> pa.RecordBatch:
    values = np.array(rows, dtype=np.uint64).view(np.int64)
    narrow = [n in ("pos", "tokens") or n.startswith("b") for n in _LINE_NAMES]
    columns = [pa.array(values[:, k].astype(np.int32 if narrow[k] else np.int64)) for k in range(values.shape[1])]
    return pa.RecordBatch.from_arrays([ids.take(owner), keys.take(owner), *columns], names=["doc", "text_key", *_LINE_NAMES])


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_key, dropped)``: places of the lines to drop, for the texts that lose any."""
    lines = _lines(docs, key, text)
    shared = lines.groupBy("leaf").agg(F.min("text_key").alias("x"), F.max("text_key").alias("y")).filter("x != y")
    rows = lines.join(shared.select("leaf"), "leaf", "left_semi")

    by_text = rows.groupBy(*_TEMPLATE, "text_key").agg(F.min(F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("d"), "pos")).alias("f"))
    templates = by_text.groupBy(*_TEMPLATE).agg(F.count(F.lit(1)).alias("texts"), F.min("f").alias("f"))
    blocks = [f"b{k}" for k in range(BLOCKS)]
    order = F.struct("texts", (-F.col("f.d")).alias("d"), (-F.col("f.pos")).alias("p"))
    hubs = templates.groupBy("leaf").agg(F.max_by(F.struct(*blocks), order).alias("hub"))
    agree = sum(F.when(F.col(b) == F.col(f"hub.{b}"), 1).otherwise(0) for b in blocks)
    member = (F.col("tokens") >= GENERAL_FROM) & (agree >= SHARED_BLOCKS)
    own = F.struct(*blocks)
    named = templates.join(hubs, "leaf").select(*_TEMPLATE, F.when(member, F.col("hub")).otherwise(own).alias("group"))

    grouped = rows.join(named, _TEMPLATE).select("leaf", "tokens", "group", "doc", "text_key", "pos", "surrounding")
    place = ["leaf", "tokens", "group"]
    texts = grouped.groupBy(*place, "text_key").agg(F.min("doc").alias("doc"))
    texts = texts.groupBy(*place).agg(F.count(F.lit(1)).alias("texts"), F.min("doc").alias("first"))
    around = grouped.select(*place, "surrounding").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("around"))
    need = F.when(F.col("tokens") >= LONG_LINE, LONG_RECURS_IN).otherwise(RECURS_IN)
    recurring = (
        texts.join(around, place)
        .filter((F.col("texts") >= need) & (F.col("around") >= need) & (2 * F.col("around") >= F.col("texts")))
        .select(*place, "first")
    )
    return (
        grouped.join(recurring, place)
        .filter(~F.col("doc").eqNullSafe(F.col("first")) | F.col("first").isNull())
        .groupBy("doc", "text_key")
        .agg(F.collect_set(F.col("pos").cast("long")).alias("dropped"))
    )


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", find=recurring_lines) -> DataFrame:
    """``(row, n_lines, n_dropped, text)``: the row as it was in a struct, and its text without the lines of ``find``."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{key}`").cast("long").alias("_doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("_key"),
    )
    found = find(docs, key, text)
    joined = rows.join(found, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_key") == F.col("text_key")), "left")
    whole = F.col(f"row.`{text}`")
    lines = F.split(whole, "\n")
    places = F.sequence(F.lit(0).cast("long"), F.size("_lines").cast("long") - 1)
    left = F.transform(F.array_except(places, F.col("dropped")), lambda i: F.get(F.col("_lines"), i.cast("int")))
    return joined.withColumn("_lines", lines).select(
        "row",
        F.when(whole.isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), whole).otherwise(F.array_join(left, "\n")).alias("text"),
    )


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", find=recurring_lines) -> DataFrame:
    """``docs`` with the remaining text, and its ``length`` where there is such a column; emptied rows go."""
    found = drop_lines(docs, key, text, find)
    rest = F.col("text")
    columns = []
    for c in docs.columns:
        value = rest if c == text else F.col(f"row.`{c}`")
        if c == length:
            value = F.when(F.col("n_dropped") > 0, F.length(rest).cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return found.filter((F.col("n_dropped") == 0) | rest.rlike(r"\S")).select(*columns)
