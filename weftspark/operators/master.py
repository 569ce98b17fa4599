"""The normalised material master: fields, document text, store, documents, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.contracts import MASTER_COLUMNS
from weftspark.functions import fields as N
from weftspark.functions.text import audit_text, first_case, master_text

# Labels of the fields in a document's text, in order.
DOCUMENT_LABELS = {
    "品类": "product_category", "规格": "spec", "颜色": "color", "面料": "fabric", "面料品类": "fabric_category", "纱支": "yarn_count",
    "密度": "density", "成分": "composition", "款式": "style", "加标方式": "label_method", "尺寸类型": "size_type",
}
# Other kinds of product and the words for them.
OTHER_PRODUCTS = (
    ("枕套", r"枕套|pillow\s*case|pillowcase"), ("床单", r"床单|bed\s*sheet|flat\s*sheet|fitted\s*sheet"), ("床笠", r"床笠|fitted"), ("保护垫", r"保护垫|mattress\s*protector|pad"),
    ("床裙", r"床裙|bed\s*skirt"), ("毛巾", r"毛巾|towel"), ("浴袍", r"浴袍|robe"), ("芯类", r"枕芯|被芯|duvet\s*insert|pillow"),
)
METADATA = ("product_category", "spec", "color", "fabric_category", "density", "composition", "style", "size_type")


def labelled_text(labels: dict[str, str], colon: str) -> Column:
    """The filled fields as label and value, joined by a wide semicolon."""
    return F.concat_ws("；", *[F.when(F.col(f) != "", F.concat(F.lit(label + colon), F.col(f))) for label, f in labels.items()])


def normalized(rows: DataFrame) -> DataFrame:
    """material_code, source_row, the raw columns as a map, the eleven fields and the document text."""
    how = {"product_category": N.master_category, "spec": N.master_spec, "color": N.master_color, "yarn_count": N.master_yarn, "density": N.master_density, "composition": N.master_composition}
    names = list(MASTER_COLUMNS.items())[1:]
    out = rows.select(
        F.col("物料编码").alias("material_code"), "source_row", F.create_map(*[x for c, _ in names for x in (F.lit(c), F.col(f"`{c}`"))]).alias("raw"),
        *[how.get(f, master_text)(F.col(f"`{c}`")).alias(f) for c, f in names],
    )
    return out.withColumn("document_text", labelled_text(DOCUMENT_LABELS, ":"))


def documents(master: DataFrame) -> DataFrame:
    """One JSON document per material: id, text, metadata."""
    return master.select(F.to_json(F.struct(F.col("material_code").alias("id"), F.col("document_text").alias("text"), F.struct("source_row", *METADATA).alias("metadata"))).alias("value"))


def write_store(master: DataFrame, path: str, overwrite: bool = False) -> None:
    """The master as Parquet by product category, sorted by the fields that recall filters on, so that row groups are skipped."""
    hot = ["color", "density", "composition", "size_type", "material_code"]
    master.repartition("product_category", F.pmod(F.xxhash64("color", "density"), F.lit(32))).sortWithinPartitions(*hot).write.mode("overwrite" if overwrite else "errorifexists").partitionBy("product_category").parquet(path)


def other_product(name: Column) -> Column:
    text = audit_text(name)
    return first_case(*[(text.rlike(p), label) for label, p in OTHER_PRODUCTS])


def category_counts(master: DataFrame) -> DataFrame:
    """Materials per kind: the product category, the other kind its name tells, or '' for neither."""
    kind = F.when(F.col("product_category") != "", F.col("product_category")).otherwise(other_product(F.col("raw")["物料名称"]))
    return master.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("source_row").alias("first_row")).orderBy(F.desc("n"), "first_row")


def unrecognised(master: DataFrame, most: int = 100) -> DataFrame:
    """The first materials, by source row, of which neither category nor name tells the kind: a report of bounded size."""
    nothing = (F.col("product_category") == "") & (other_product(F.col("raw")["物料名称"]) == "")
    return master.filter(nothing).select("source_row", "material_code").orderBy("source_row", "material_code").limit(most)


def style_counts(master: DataFrame) -> DataFrame:
    """One row: materials, and those without a style."""
    return master.agg(F.count(F.lit(1)).alias("materials"), F.count_if(F.col("style") == "").alias("empty_style"))


def write_documents(master: DataFrame, path: str, overwrite: bool = False) -> None:
    """The documents as JSON lines, ordered by source row within files that follow one another."""
    lines = master.repartitionByRange("source_row").sortWithinPartitions("source_row")
    documents(lines).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def spec_formats(master: DataFrame) -> DataFrame:
    spec = F.col("spec")
    form = first_case((spec == "", "empty"), (F.contains(spec, F.lit("+")), "size_with_extension"), (F.contains(spec, F.lit("*")) & spec.endswith("cm"), "cm_size"), otherwise="other")
    return master.groupBy(form.alias("format")).agg(F.count(F.lit(1)).alias("n"))
