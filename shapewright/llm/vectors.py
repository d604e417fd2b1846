"""What the operators on vectors share: checks of rows, matrices of batches, whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    limit = F.lit(float("inf"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == limit))
    return F.coalesce(~bad, F.lit(False))


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the lists of numbers, which hold no null."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[starts[rows][:, None] + np.arange(length)]


def lists_of(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    rows, across = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * across, pa.int32()), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Each group of like ``keys``, from frames that come sorted by them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        own = frame[keys].to_numpy()
        cuts = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != own[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        bounds = [0, *cuts.tolist(), len(frame)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            held.append(frame.iloc[a:b])
            if k < len(cuts):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)
