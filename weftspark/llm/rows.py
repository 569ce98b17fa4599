"""Row-wise Arrow operators that keep every column of their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftspark.llm.arrow_text import small_batches

#: Columns that operators add while rows pass through carry this prefix, so that no input column clashes with them.
PRIVATE = "__weft_"


def add_columns(docs: DataFrame, fields: dict[str, str], compute: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]]) -> DataFrame:
    """docs with the private columns `fields` (name -> type) behind its own.

    compute gets the batches of a partition and yields, batch for batch, the arrays of the new columns.
    """
    small_batches(docs.sparkSession)
    extra = T._parse_datatype_string(", ".join(f"{PRIVATE}{k} {v}" for k, v in fields.items()))
    names = [*docs.columns, *extra.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen.append(batch)
                yield batch

        for arrays in compute(noted()):
            batch = seen.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra.fields]))
