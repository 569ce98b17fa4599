"""The reviewers' loop: what they fill in against materials and candidates, and how good the ranking was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators.contracts import broken
from weftspark.operators.states import number_gaps

# The conclusions a reviewer can choose.
RECOMMENDED, OTHER, OUTSIDE = "推荐编码正确", "Top候选中其他编码正确", "Top候选外编码正确"
NO_MATERIAL, WRONG_FIELDS = "物料库不存在对应物料", "订单字段解析错误"
CONCLUSIONS = (RECOMMENDED, OTHER, OUTSIDE, NO_MATERIAL, WRONG_FIELDS, "信息不足无法判断")


def issues(review: DataFrame, materials: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per broken rule: level, audit_id, rule.

    review: audit_id, recommended, correct, conclusion, fix_fields (all text, '' for empty); materials: material_code;
    candidates: audit_id, material_code.
    """
    known = materials.select(F.col("material_code").alias("correct"), F.lit(True).alias("_known")).distinct()
    listed = candidates.select("audit_id", F.col("material_code").alias("correct"), F.lit(True).alias("_listed")).distinct()
    rows = review.join(known, "correct", "left").join(listed, ["audit_id", "correct"], "left")
    c, filled = F.col("conclusion"), F.col("correct") != ""
    is_known, is_listed = F.col("_known").isNotNull(), F.col("_listed").isNotNull()
    rules = {
        "unknown_conclusion": (c != "") & ~c.isin(*CONCLUSIONS),
        "unknown_material": filled & ~is_known,
        "recommended_without_code": (c == RECOMMENDED) & ~filled,
        "recommended_differs": (c == RECOMMENDED) & filled & (F.col("correct") != F.col("recommended")),
        "other_without_code": (c == OTHER) & ~filled,
        "other_not_a_candidate": (c == OTHER) & filled & ~is_listed,
        "outside_without_code": (c == OUTSIDE) & ~filled,
        "outside_is_a_candidate": (c == OUTSIDE) & filled & is_listed,
        "no_material_with_code": (c == NO_MATERIAL) & filled,
        "wrong_fields_not_named": (c == WRONG_FIELDS) & (F.col("fix_fields") == ""),
        "id_not_a_number": ~F.col("audit_id").rlike(r"^\d+$"),
    }
    found = broken(rows, ["audit_id"], rules)
    repeated = review.groupBy("audit_id").count().filter("count > 1").select("audit_id", F.lit("id_repeated").alias("rule"))
    numbers = review.filter(F.col("audit_id").rlike(r"^\d+$")).select(F.col("audit_id").cast("bigint").alias("n"))
    gaps = number_gaps(numbers.unionByName(review.sparkSession.range(0, 1).select(F.col("id").alias("n"))), "n").select(F.col("n").cast("string").alias("audit_id"), F.lit("id_missing").alias("rule"))
    lost = candidates.select("audit_id").distinct().join(review.select("audit_id"), "audit_id", "left_anti").withColumn("rule", F.lit("candidate_without_row"))
    errors = found.unionByName(repeated).unionByName(gaps).unionByName(lost).select(F.lit("error").alias("level"), "audit_id", "rule")
    warnings = review.filter("conclusion = '' and correct <> ''").select(F.lit("warning").alias("level"), "audit_id", F.lit("code_without_conclusion").alias("rule"))
    return errors.unionByName(warnings)


def metrics(review: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: counts of rows by outcome, hits of the true code within ranks 1, 3 and 10 with their rates, and how often
    nothing was recommended where no material exists.  Rates are null without rows to count."""
    best = candidates.groupBy("audit_id", F.col("material_code").alias("correct")).agg(F.min("rank").alias("rank"))
    rows = review.join(best, ["audit_id", "correct"], "left")
    c = F.col("conclusion")
    positive = c.isin(RECOMMENDED, OTHER, OUTSIDE)
    hit = {k: F.count_if(positive & (F.col("rank") <= k)) for k in (1, 3, 10)}
    truth, none = F.count_if(positive), F.count_if(c == NO_MATERIAL)
    silent = F.count_if((c == NO_MATERIAL) & (F.col("recommended") == ""))
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(c != "").alias("reviewed_rows"), truth.alias("positive_truth_rows"), none.alias("no_material_truth_rows"),
        F.count_if((c != "") & ~positive & (c != NO_MATERIAL)).alias("excluded_rows"), *[h.alias(f"top{k}_hits") for k, h in hit.items()],
        *[F.try_divide(h, truth).alias(f"top{k}_rate") for k, h in hit.items()], (truth - hit[10]).alias("outside_top10"), silent.alias("no_recommendation_hits"),
        (none - silent).alias("false_recommendations"), F.try_divide(silent, none).alias("no_recommendation_rate"),
    )


def review_tables(matches: DataFrame, decisions: DataFrame, orders: DataFrame, materials: DataFrame) -> dict[str, DataFrame]:
    """The contents of a review workbook: one row per order to fill in, its candidates, its open questions, the materials.

    matches: order_id, rank, material_code, match_score, fields; decisions: order_id, decision, top1_margin; orders:
    order_id, source_file, line_number; materials: material_code and its fields.
    """
    from pyspark.sql import Window

    numbered = orders.withColumn("audit_id", F.row_number().over(Window.partitionBy("source_file").orderBy("line_number", "order_id")))
    before = numbered.groupBy("source_file").agg(F.max("audit_id").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    numbered = numbered.join(before.select("source_file", offset.alias("_offset")), "source_file").withColumn("audit_id", (F.col("audit_id") + F.col("_offset")).cast("string")).drop("_offset")
    top = matches.filter("ordinal = 1").select("order_id", F.col("material_code").alias("recommended"), "match_score")
    sheet = numbered.join(decisions.select("order_id", "decision", "top1_margin"), "order_id", "left").join(top, "order_id", "left")
    empty = {c: F.lit("") for c in ("correct", "conclusion", "fix_fields", "reviewer", "remark")}
    sheet = sheet.withColumn("recommended", F.coalesce("recommended", F.lit(""))).withColumns(empty)
    details = matches.join(numbered.select("order_id", "audit_id"), "order_id")
    questions = sheet.filter("decision <> 'unique_best_candidate'").select("audit_id", "order_id", F.col("decision").alias("question"))
    return {"review": sheet, "candidates": details, "questions": questions, "materials": materials.orderBy("material_code")}
