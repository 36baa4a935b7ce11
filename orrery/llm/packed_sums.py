"""Sums of arrays of one fixed size over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from orrery.llm.common import give_back

SEGMENTS = 32


def total(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all batches of rows of what add(sums, batch) puts into an array of `size` 64-bit integers.

    Each task sums its own rows and sends SEGMENTS parts, compressed, as a short task fills few places; the parts are summed by segment, and the total, whose size doesn't
    depend on the rows, comes to the driver.
    """
    padded = -(-size // SEGMENTS) * SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(padded, np.int64)
        for b in batches:
            add(sums, b)
        give_back()
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in sums.reshape(SEGMENTS, -1)], pa.binary())], names=["segment", "sums"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(padded // SEGMENTS, np.int64)
        for s in part["sums"]:
            sums += np.frombuffer(zstandard.decompress(s), np.int64)
        return pd.DataFrame({"segment": [int(part["segment"].iloc[0])], "sums": [zstandard.compress(sums.tobytes(), 1)]})

    schema = "segment int, sums binary"
    out = np.zeros((SEGMENTS, padded // SEGMENTS), np.int64)
    for r in rows.mapInArrow(count, schema).groupBy("segment").applyInPandas(merge, schema).collect():
        out[r["segment"]] = np.frombuffer(zstandard.decompress(r["sums"]), np.int64)
    return out.ravel()[:size]
