"""Texts that stay where they were written: what is found out about them comes to them, and they are never shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from evalspark.functions.batches import pieces, slices
from evalspark.session import scratch_path

# ``monotonically_increasing_id`` has the partition above these bits.
_PART_BITS = 33
# Facts are opened again for each slice of texts, so their row groups are small.
_ROW_GROUP = 1 << 20
# Bytes of texts whose facts are held at once.
_SLICE = 8 << 20

#: ``(row, ord, text, facts)`` to rows of the result.
Body = Callable[[int, int | None, str | None, list[dict]], Iterable[tuple]]


def place(texts: DataFrame, label: str) -> DataFrame:
    """``texts`` written once and compressed, with ``row``: the part that wrote it and its place there."""
    path = scratch_path(texts.sparkSession, label)
    texts.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.parquet(path)


def _address(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def _facts(path: str, first: int, last: int) -> pa.Table | None:
    """The facts of the rows ``first`` .. ``last`` of one part, in their order."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(f"{_address(path)}/part={first >> _PART_BITS}")
    if fs.get_file_info(folder).type != pyarrow.fs.FileType.Directory:
        return None
    within = (pc.field("row") >= first) & (pc.field("row") <= last)
    return pq.read_table(folder, filesystem=fs, partitioning=None, filters=within, use_threads=False).sort_by("row")


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind.value_type))


def _size(row: tuple) -> int:
    return sum(getattr(x, "nbytes", 16) for x in row)


def beside(placed: DataFrame, facts: DataFrame, body: Body, schema: pa.Schema) -> DataFrame:
    """``body`` for each text of ``placed`` (``row``, ``ord``, ``norm``) that has facts, with all of its facts.

    Facts (``row`` and values of their own) are written by part; a task opens those of the rows it holds, a slice at a time.
    """
    path = scratch_path(placed.sparkSession, "facts")
    parted = facts.withColumn("part", F.shiftright("row", _PART_BITS)).repartition("part").sortWithinPartitions("part", "row")
    parted.write.option("compression", "zstd").option("parquet.block.size", _ROW_GROUP).partitionBy("part").parquet(path)

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        rows = batch.column("row").to_numpy()
        cuts = np.flatnonzero(np.diff(rows >> _PART_BITS)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            known = _facts(path, int(rows[start:end].min()), int(rows[start:end].max())) if end > start else None
            if known is None:
                continue
            of = known.column("row").to_numpy()
            lows, highs = (np.searchsorted(of, rows[start:end], side=s).tolist() for s in ("left", "right"))
            for i, low, high in zip(range(start, end), lows, highs):
                if low < high:
                    order, text = batch.column("ord")[i].as_py(), batch.column("norm")[i].as_py()
                    yield from body(int(rows[i]), order, text, known.slice(low, high - low).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SLICE):
            for held in pieces(found(batch), _size):
                yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return placed.select("row", "ord", "norm").mapInArrow(run, from_arrow_schema(schema))
