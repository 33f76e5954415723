"""Exact duplicates by a tree of merges over sorted runs of digests.

Every row gives the digest of its whole text and starts at a *place*, a block of rows chosen by position, never by
content. A place holds one sorted run, in which a digest stands once with the row that stays and the number of rows.
Places are numbered with ``rounds`` digits. In round ``r`` the places that differ in digit ``r`` alone exchange their
runs: each entry moves to the place whose digit ``r`` is that of its digest, where the arriving runs are merged. After the last round an entry
stands at the place its digest names, and its count covers all rows.

The way back takes the same steps: an entry of a level finds its successor by (next place, digest), and at most
``FAN`` entries share one, however often the text occurs. A text that makes up a third of all rows is therefore an entry per place in the
first exchange and ``FAN`` times fewer in each one after.

Entries count as equal only where SHA-256, length in bytes and a second hash agree, on every level. Levels are written to the shared
scratch folder, so a lost executor repeats one round at most. A task holds about ``RUN_ROWS`` entries on disk and one
batch in memory: Spark's sort brings the runs of a place together and ``_merge`` folds what stands side by side.

Defined results: a null text counts as empty. Of equal texts the row with the largest (or smallest) id stays, any id
before null; among equal ids the first row as read. Rows that repeat as a whole are counted one by one. Other columns
aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import remove_path, scratch_path

FAN_BITS = 3
FAN = 1 << FAN_BITS
RUN_ROWS = 1 << 18
# Rows that lie beside each other in the input start at the same place.
BLOCK_BITS = 10
LEAST_ROUNDS = 2

_SAME = ["place", "digest", "bytes", "check"]
_ENTRY = "place long, digest binary, bytes long, check long, keep_id long, keep_row long, n long"


def rounds_for(rows: int, run_rows: int = RUN_ROWS, least: int = LEAST_ROUNDS) -> int:
    rounds = least
    while (run_rows << (FAN_BITS * rounds)) < rows:
        rounds += 1
    return rounds


def _digit(value: Column, r: int) -> Column:
    return F.shiftright(value, FAN_BITS * r).bitwiseAND(FAN - 1)


def _next_place(r: int) -> Column:
    """The place an entry moves to in round ``r``: its digit ``r`` becomes that of the digest."""
    named = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    here = F.col("place")
    return here + F.shiftleft(_digit(named, r) - _digit(here, r), FAN_BITS * r)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold neighbours that are the same text: the first one stays, counts are added."""
    held = None
    for batch in batches:
        # By names, as a batch may declare columns without nulls that the held row doesn't.
        rows = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        other = np.zeros(rows.num_rows - 1, dtype=bool)
        for name in _SAME:
            column = rows[name]
            other |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(other) + 1))
        counts = np.add.reduceat(rows["n"].to_numpy(), starts)
        folded = rows.take(pa.array(starts)).set_column(rows.schema.get_field_index("n"), "n", pa.array(counts))
        held = folded.slice(folded.num_rows - 1)
        yield from folded.slice(0, folded.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _run(entries: DataFrame, places: int, largest: bool) -> DataFrame:
    """The runs that arrive at each place, merged."""
    first = F.col("keep_id").desc_nulls_last() if largest else F.col("keep_id").asc_nulls_last()
    arrived = entries.repartition(places, "place").sortWithinPartitions(*_SAME, first, "keep_row")
    return arrived.mapInArrow(_merge, _ENTRY)


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    largest: bool = True,
    run_rows: int = RUN_ROWS,
    least_rounds: int = LEAST_ROUNDS,
) -> DataFrame:
    """``key``, keep_id, group_size, kept, text_sha256: one row for every row of ``docs``.

    ``normalise`` maps the text before it is digested; without it texts are compared as they are.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = normalise(whole) if normalise else whole
    read = docs.select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("whole"), F.monotonically_increasing_id().alias("row"))
    digested = read.select(
        "id",
        "row",
        F.unhex(F.sha2("whole", 256)).alias("digest"),
        F.octet_length("whole").cast("long").alias("bytes"),
        F.xxhash64("whole").alias("check"),
    )
    rows, _ = _written(digested, "digests")
    rounds = rounds_for(rows.count(), run_rows, least_rounds)
    places = 1 << (FAN_BITS * rounds)
    rows = rows.withColumn("place", F.pmod(F.xxhash64(F.shiftright("row", BLOCK_BITS)), F.lit(places)))

    leaf = rows.select(*_SAME, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))
    levels = [_written(_run(leaf, places, largest), "run-0")]
    for r in range(rounds):
        moved = levels[r][0].withColumn("place", _next_place(r)).select(*leaf.columns)
        levels.append(_written(_run(moved, places, largest), f"run-{r + 1}"))

    known, last = levels[rounds]
    for r in reversed(range(rounds)):
        entries = levels[r][0].select(*_SAME, _next_place(r).alias("next"))
        answer = known.select(F.col("place").alias("next"), *_SAME[1:], "keep_id", "keep_row", "n")
        known, path = _written(entries.join(answer, ["next", *_SAME[1:]]).drop("next"), f"known-{r}")
        # Both are used up: the level above and its answer.
        for used in {last, levels[r + 1][1]}:
            remove_path(docs.sparkSession, used)
        last = path
    remove_path(docs.sparkSession, levels[0][1])
    return rows.join(known, _SAME).select(
        F.col("id").alias(key),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
