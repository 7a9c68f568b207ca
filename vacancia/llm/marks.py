"""Bit maps of a fixed size that preselect rows: whoever is marked is kept, and maybe a few more."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import _mixed

#: Bits of a map, a power of two: 2 MB packed; and the slices in which tasks hand it on.
BITS = 1 << 24
SLICES = 16


def slot_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each number."""
    return (_mixed(numbers.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def marks_of(numbers: DataFrame, bits: int = BITS) -> np.ndarray:
    """A boolean map of the numbers in the only column (long, not null) of a table.

    Each task marks its own map; slices of them are joined in the cluster, so the driver reads
    ``bits`` / 8 bytes whatever the input.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits, bool)
        for batch in batches:
            marks[slot_of(batch.column(0).to_numpy(), bits)] = True
        parts = [(i, np.packbits(part).tobytes()) for i, part in enumerate(marks.reshape(SLICES, -1)) if part.any()]
        if parts:
            slices, packed = zip(*parts)
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(packed, pa.binary())], ["slice", "part"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["part"].iloc[0], np.uint8)
        for part in frame["part"].iloc[1:]:
            total = total | np.frombuffer(part, np.uint8)
        return pd.DataFrame({"slice": frame["slice"][:1], "part": [total.tobytes()]})

    whole = np.zeros((SLICES, bits // SLICES), bool)
    shape = "slice int, part binary"
    for row in numbers.mapInArrow(mark, shape).groupBy("slice").applyInPandas(join, shape).collect():
        whole[row["slice"]] = np.unpackbits(np.frombuffer(row["part"], np.uint8)).astype(bool)
    return whole.reshape(-1)
