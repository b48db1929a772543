"""Shared helpers: reading tables, checkpoints, and Arrow text columns as byte buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from blinkframe.sources.shared import checkpoint, shared_folder

__all__ = ["checkpoint", "shared_folder", "slices", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one buffer, and its n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), bounds


def slices(bounds: np.ndarray, most_bytes: int) -> list[tuple[int, int]]:
    """Cut rows into runs of about ``most_bytes`` of text; a longer row gets a run of its own."""
    found, start, n = [], 0, len(bounds) - 1
    while start < n:
        end = int(np.searchsorted(bounds, bounds[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), n)
        found.append((start, end))
        start = end
    return found
