"""Vector indexes: Parquet tables of positions in document order, one for all materials and one for those with a category."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.operators.recall import vector_topk
from weftspark.session import stored
from weftspark.sources.documents import ContractError, require
from weftspark.sources.sinks import canonical, exists, read_text, remove, write_text

SCOPES = {"all": "true", "category": "product_category <> ''"}


def with_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with 0, 1, 2, ... in this order: ranges are sorted and counted by themselves, and the counts before them added."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", within).join(counts.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_range", "_at", "_before")


def _fingerprint(rows: DataFrame) -> dict[str, object]:
    """Rows, dimension and a hash of all contents that no order of files changes."""
    one = F.sha2(F.concat_ws("\n", F.col("position").cast("string"), "material_code", F.array_join(F.col("vector").cast("array<string>"), ",")), 256)
    folded = F.bit_xor(F.conv(F.left(one, F.lit(15)), 16, 10).cast("bigint"))
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dimension"), folded.alias("hash")).first()
    return found.asDict()


def write_index(documents: DataFrame, vectors: DataFrame, path: str, overwrite: bool = False) -> dict[str, object]:
    """Both scopes of an index below path, and a manifest of what they hold, which is written last.

    documents: material_code, source_row, product_category; vectors: material_code, vector.  Positions follow source_row.
    """
    spark = documents.sparkSession
    if exists(spark, f"{path}/manifest.json"):
        if not overwrite:
            raise ContractError(f"{path} has an index")
        remove(spark, path)
    rows = documents.select("material_code", "source_row", "product_category").join(vectors.select("material_code", "vector"), "material_code")
    manifest = {}
    for scope, condition in SCOPES.items():
        own = with_positions(rows.filter(condition), ["source_row", "material_code"])
        own.select("position", "material_code", "source_row", "vector").write.mode("overwrite").parquet(f"{path}/{scope}")
        manifest[scope] = _fingerprint(spark.read.parquet(f"{path}/{scope}"))
    write_text(spark, f"{path}/manifest.json", canonical(manifest))
    return manifest


def read_index(spark: SparkSession, path: str, scope: str = "category") -> DataFrame:
    """One scope of an index, if it is what its manifest says: positions without gaps, ids once, vectors of one length."""
    wanted = json.loads(read_text(spark, f"{path}/manifest.json"))[scope]
    rows = spark.read.parquet(f"{path}/{scope}")
    if _fingerprint(rows) != wanted:
        raise ContractError(f"{path}/{scope} is not what its manifest says")
    found = rows.agg(F.count_distinct("position").alias("places"), F.count_distinct("material_code").alias("ids"), F.min("position").alias("low"), F.max("position").alias("high"), F.count_if(F.size("vector") != wanted["dimension"]).alias("odd")).first()
    n = wanted["rows"]
    require("position is missing or repeated", int(n > 0 and (found["places"], found["low"], found["high"]) != (n, 0, n - 1)))
    require("material_code is repeated", n - found["ids"])
    require("vector of another length", found["odd"])
    return rows


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest materials of every query (query_id, vector), with rank and similarity."""
    return vector_topk(queries, index.select(F.col("material_code").alias("item_id"), "vector"), k)
