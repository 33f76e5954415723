"""Pandas frames with whole numbers that may be null."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd


def frame(rows: Iterable[tuple], names: Sequence[str], nullable: Sequence[str] = ()) -> pd.DataFrame:
    """Rows as a frame. ``nullable`` columns become ``Int64`` at once, as a detour by floats would round ids; for that reason tasks also get such ids as text."""
    columns = list(zip(*rows)) or [()] * len(names)
    return pd.DataFrame(
        {n: pd.array([None if pd.isna(x) else int(x) for x in c], dtype="Int64") if n in nullable else list(c) for n, c in zip(names, columns)}
    )
