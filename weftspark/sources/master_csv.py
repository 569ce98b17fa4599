"""The material master from a CSV file: encoding and delimiter by inspection, strict columns."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.contracts import MASTER_COLUMNS

#: Bytes at the front that tell encoding and delimiter.
PROBE = 1 << 16


class MasterError(ValueError):
    """The master file breaks its contract."""


def probe(spark: SparkSession, path: str) -> dict[str, object]:
    """sha256, size, encoding and delimiter of the file; only its front comes to the driver."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "length", F.expr(f"substring(content, 1, {PROBE})").alias("front"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8")).first()
    if row is None:
        raise MasterError(f"no such file: {path}")
    front = bytes(row["front"])
    encoding = "UTF-8" if row["utf8"] else "GB18030"
    text = front.decode("utf-8-sig" if encoding == "UTF-8" else "gb18030", "ignore")
    try:
        delimiter = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    return {"sha256": row["sha256"], "size": row["length"], "encoding": encoding, "delimiter": delimiter, "header": next(csv.reader(text.splitlines(), delimiter=delimiter), [])}


def read_master(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, object]]:
    """Rows of the master as text, '' for empty, with source_row (the header is row 1); and what probe found.

    Lines are read in parallel and numbered by their place: rows of a wrong width, empty and repeated codes are errors.
    """
    found = probe(spark, path)
    if found["header"] != list(MASTER_COLUMNS):
        raise MasterError(f"unexpected columns: {found['header']}")
    names = list(MASTER_COLUMNS)
    if found["encoding"] != "UTF-8":
        return _legacy(spark, path, found, names), found
    schema = ", ".join(f"`{c}` string" for c in names) + ", `_broken` string"
    rows = spark.read.schema(schema).options(sep=found["delimiter"], encoding=found["encoding"], columnNameOfCorruptRecord="_broken", mode="PERMISSIVE", header="true", enforceSchema="true", columnPruning="false").csv(path)
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    first = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per split
    before, total = {}, 2
    for r in sorted(first, key=lambda r: r["_part"]):
        before[r["_part"]] = total
        total += r["n"]
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(2))
    rows = rows.withColumn("source_row", starts[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return rows.select("source_row", *[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names], "_broken"), found


def _legacy(spark: SparkSession, path: str, found: dict[str, object], names: list[str]) -> DataFrame:
    """A file in an encoding that Spark's reader does not take, decoded whole by one task."""
    delimiter, width = found["delimiter"], len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                lines = list(csv.reader(content.decode("gb18030").splitlines(), delimiter=delimiter))[1:]
                rows = [(i, *[v.strip() for v in (line + [""] * width)[:width]], None if len(line) == width else delimiter.join(line)) for i, line in enumerate(lines, 2)]
                yield pd.DataFrame(rows, columns=["source_row", *names, "_broken"])

    schema = "source_row long, " + ", ".join(f"`{c}` string" for c in names) + ", `_broken` string"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def checked(rows: DataFrame) -> DataFrame:
    """rows without the helper column, if none is broken and every code is filled and unique."""
    broken, empty, n = rows.agg(F.count_if(F.col("_broken").isNotNull()), F.count_if(F.col("物料编码") == ""), F.count(F.lit(1))).first()
    repeated = rows.filter("`物料编码` <> ''").groupBy("物料编码").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") - 1)).first()[0]
    if broken or empty or repeated:
        raise MasterError(f"{broken} broken rows, {empty} empty codes, {repeated or 0} repeated codes in {n} rows")
    return rows.drop("_broken")
