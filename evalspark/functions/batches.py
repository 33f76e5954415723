"""Results of Python tasks handed on in pieces of bounded size, whatever the size of the batches that come in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes (or characters) of results in one piece, and bytes of one slice of a batch.
PIECE = 1 << 20


def pieces(rows: Iterable[tuple], size: Callable[[tuple], int], limit: int = PIECE) -> Iterator[list[tuple]]:
    """``rows`` in lists, each closed once the sizes of its rows reach ``limit``."""
    held, filled = [], 0
    for row in rows:
        held.append(row)
        filled += size(row)
        if filled >= limit:
            yield held
            held, filled = [], 0
    if held:
        yield held


def slices(batches: Iterable[pa.RecordBatch], limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in order, cut until a slice has at most ``limit`` bytes or one row."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > limit:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part
