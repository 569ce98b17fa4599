"""Helpers for Arrow batches of texts inside mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows in an Arrow batch. With texts of some hundred kilobytes at most a batch stays at tens of megabytes.
ROWS_PER_BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Spark hands to Python workers, so that long texts do not pile up in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, end to end, and n + 1 offsets into them; a null is an empty text."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def texts(array: pa.Array) -> Iterator[bytes]:
    """Each text as bytes, a null as an empty text."""
    raw, offs = utf8(array)
    whole = raw.tobytes()
    for i in range(len(offs) - 1):
        yield whole[offs[i] : offs[i + 1]]
