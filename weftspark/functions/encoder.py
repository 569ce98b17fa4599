"""Text encoders as Arrow functions; the model is a parameter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.functions.vectors import is_valid

Encoder = Callable[[list[str]], np.ndarray]
BATCH = 16


def hash_encoder(dimension: int = 64) -> Encoder:
    """A deterministic stand-in: character trigrams hashed into signed buckets, scaled to unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            padded = f"  {text} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                row[h % dimension] += 1 if h >> 63 else -1
            row[0] += not row.any()
            row /= np.linalg.norm(row)
        return out

    return encode


def encode_texts(df: DataFrame, make_encoder: Callable[[], Encoder], text: str = "text", vector: str = "vector") -> DataFrame:
    """df with a vector of every text.  make_encoder runs once per task, so that a model is loaded once, not per row."""

    names = [*df.columns, vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or make_encoder()
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rows = [v for i in range(0, len(texts), BATCH) for v in encode(texts[i : i + BATCH]).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))]))


def assert_valid(df: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """df whose rows fail the job if a vector has the wrong size, a number that is not finite, or not unit length."""
    return df.withColumn(vector, F.when(is_valid(F.col(vector), dimension), F.col(vector)).otherwise(F.raise_error(F.lit("invalid vector")).cast("array<float>")))
