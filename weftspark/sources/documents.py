"""Documents and paired outputs with strict shape checks, and sheets read by their header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.contracts import FORMAL_FIELDS, FORMAL_SCHEMA
from weftspark.operators.sheets import SHEET

# What the names of results and reports may end in.
STEM_ENDINGS = r"(_parse_report|_result|_gate2d)$"
DOCUMENT_SCHEMA = "id string, text string, metadata map<string,string>"


class ContractError(ValueError):
    """Data breaks its contract."""


def require(problem: str, count: int) -> None:
    if count:
        raise ContractError(f"{count} times: {problem}")


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, if its key is filled and unique."""
    empty = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) == "").count()
    require(f"{key} is empty", empty)
    require(f"{key} is repeated", df.groupBy(key).count().filter("count > 1").count())
    return df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document lines (id, text, metadata); an error for blank or malformed lines, missing or repeated ids."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", DOCUMENT_SCHEMA).alias("d"))
    bad = F.col("d").isNull() | F.col("d.id").isNull() | F.col("d.text").isNull() | F.col("d.metadata").isNull() | F.col("d.metadata.source_row").try_cast("bigint").isNull()
    require("line is no document", parsed.filter((F.trim("value") == "") | bad).count())
    return unique(parsed.select("d.id", "d.text", "d.metadata"), "id")


def pairing(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Each key of either side and whether both have it: paired, left_only or right_only."""
    both = left.select(*key).distinct().withColumn("_l", F.lit(1)).join(right.select(*key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    kind = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("paired")
    return both.select(*key, kind.alias("pairing"))


def set_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """What only one of two sets of rows has, nulls equal to nulls; the sets are equal if nothing comes out."""
    one = first.subtract(second).select(F.lit("only_first").alias("side"), *first.columns)
    return one.unionByName(second.subtract(first).select(F.lit("only_second").alias("side"), *first.columns))


def store_differences(store: DataFrame, documents: DataFrame) -> DataFrame:
    """Where a material store and its documents differ: side, id and difference (missing, text or source_row).

    side tells who has the row: material_store, documents or both.  Nothing comes out of a store that equals its documents.
    """
    own = store.select(F.col("material_code").alias("id"), F.col("document_text").alias("_text"), F.col("source_row").cast("bigint").alias("_row"), F.lit(True).alias("_own"))
    other = documents.select("id", "text", F.col("metadata")["source_row"].try_cast("bigint").alias("row"), F.lit(True).alias("_other"))
    both = own.join(other, "id", "full_outer")
    lone = F.col("_own").isNull() | F.col("_other").isNull()
    side = F.when(F.col("_other").isNull(), "material_store").when(F.col("_own").isNull(), "documents").otherwise("both")
    differences = F.array(F.when(lone, "missing"), F.when(~lone & ~F.col("_text").eqNullSafe(F.col("text")), "text"), F.when(~lone & ~F.col("_row").eqNullSafe(F.col("row")), "source_row"))
    return both.select(side.alias("side"), "id", F.explode(F.array_compact(differences)).alias("difference"))


def material_candidates(spark: SparkSession, store: str) -> DataFrame:
    """The store's columns that matching needs, one row per code."""
    columns = ("material_code", "source_row", "product_category", "spec", "color", "fabric", "fabric_category", "density", "composition", "style", "label_method", "size_type", "document_text")
    return unique(spark.read.parquet(store).select(*columns), "material_code")


def material_index(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).select("material_code", "product_category", "spec", "color", "fabric", "style", "size_type").orderBy("material_code")


def paired_records(spark: SparkSession, results: str, reports: str) -> DataFrame:
    """Records of result files beside the records of the report with the same stem: stem, position, record, line, fields.

    Results are JSON lists of 20-field objects, <stem>.json; reports are objects with `records`, <stem>_parse_report.json.
    Files without partner, lists of unequal length and unequal line numbers are errors.
    """
    stem = lambda ending: F.regexp_extract(F.input_file_name(), rf"([^/]+){ending}$", 1)
    left = spark.read.schema(FORMAL_SCHEMA).json(results, multiLine=True).select(stem(r"\.json").alias("stem"), F.struct(*[F.col(f"`{f}`") for f in FORMAL_FIELDS]).alias("record"), F.monotonically_increasing_id().alias("_at"))
    left = left.withColumn("position", F.row_number().over(Window.partitionBy("stem").orderBy("_at")) - 1).drop("_at")
    right = spark.read.schema("records array<struct<`行号`: string, fields: map<string, struct<status: string, value: string>>>>").json(reports, multiLine=True)
    right = right.select(stem(r"_parse_report\.json").alias("stem"), F.posexplode("records").alias("position", "r")).select("stem", "position", F.col("r.行号").alias("line"), "r.fields")
    both = left.join(right, ["stem", "position"], "full_outer")
    require("record without partner", both.filter(F.col("record").isNull() | F.col("line").isNull()).count())
    require("line numbers differ", both.filter(F.col("record.行号") != F.col("line")).count())
    return both


def by_stem(spark: SparkSession, **folders: str) -> DataFrame:
    """One row per stem of file names with the path in each folder, null where it is missing.

    A file of the plain name outranks one with an ending that marks a result.
    """
    out = None
    for name, folder in folders.items():
        whole = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
        stem = F.regexp_replace(whole, STEM_ENDINGS, "")
        files = spark.read.format("binaryFile").load(folder).select(stem.alias("stem"), (whole != stem).alias("marked"), "path")
        own = files.groupBy("stem").agg(F.min_by("path", F.struct("marked", "path")).alias(name))
        out = own if out is None else out.join(own, "stem", "full_outer")
    return out


def by_line(artifacts: DataFrame, lines: DataFrame, line: str = "line") -> DataFrame:
    """The rows of an artifact whose line number is asked for, white space and a trailing .0 aside; several are all given."""
    plain = F.regexp_replace(F.trim(F.col(line).cast("string")), r"\.0$", "")
    return artifacts.withColumn("_line", plain).join(lines.select(plain.alias("_line")).distinct(), "_line", "left_semi").drop("_line")


def sheet_table(cells: DataFrame, sheet: str, header: list[str]) -> DataFrame:
    """The rows of a sheet below its first, columns by header; an error if the header differs.  Empty rows are left out."""
    own = cells.filter(F.col("sheet") == sheet)
    found = {r["col"]: r["text"] for r in own.filter(F.col("row") == 1).filter(F.col("col") <= len(header)).select("col", "text").collect()}  # one row of a sheet
    require(f"unexpected header in {sheet}: {found}", int([found.get(i, "") for i in range(1, len(header) + 1)] != header))
    value = [F.coalesce(F.max(F.when(F.col("col") == i, F.col("text"))), F.lit("")).alias(h) for i, h in enumerate(header, 1)]
    rows = own.filter("row > 1").groupBy(*SHEET, "row").agg(*value)
    return rows.filter(F.concat_ws("", *[F.col(f"`{h}`") for h in header]) != "")


def manifest(master: DataFrame, probe: dict[str, object], outputs: dict[str, int]) -> dict[str, object]:
    """Where the master came from, its quality and distributions, as one document."""
    from weftspark.operators.master import category_counts, spec_formats
    from weftspark.operators.summary import column_audit, most_common

    audit = column_audit(master, ["material_code", "spec", "color", "fabric_category", "density", "composition", "style"], key="material_code")
    return {
        "source": {k: probe[k] for k in ("sha256", "size", "encoding", "delimiter")},
        "quality": {r["column_name"]: {"empty": r["empty_count"], "distinct": r["distinct_count"]} for r in audit.collect()},
        "category": {r["kind"]: r["n"] for r in category_counts(master).collect()},
        "statistics": {c: {r[c]: r["n"] for r in most_common(master, c, 20).collect()} for c in ("color", "fabric_category", "density", "composition")} | {"spec": {r["format"]: r["n"] for r in spec_formats(master).collect()}},
        "outputs": outputs,
    }
