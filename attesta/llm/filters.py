"""Filters of fixed size over 64-bit keys, which go to every task whatever the number of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First bits of a key that the filter tells apart: it takes 2 ** BITS bits. More keys only let more through.
BITS = 24


def key_filter(keys: DataFrame) -> bytes:
    """A bit for each value of the first BITS bits that some row's ``key`` (a long) has.

    The bits are set and combined by Spark; the driver gets at most 2 ** (BITS - 5) numbers.
    """
    cell = F.shiftrightunsigned("key", 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(31)).cast("int"))
    cells = keys.select(F.shiftright(cell, 5).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), "<u4")
    out[cells.column("at").to_numpy()] = cells.column("bits").to_numpy().astype("<u4")
    return out.tobytes()


def in_filter(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` (unsigned 64-bit) the filter lets through; ``cells`` are its bytes."""
    at = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    return (cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
