"""Field values from a model's candidates and from the rules: binding to evidence, comparison, decision, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions.text import audit_text, collapse, let, master_text, text_of

# Field groups of the decision policy; the first group's differences are severe.
HIGH_REVIEW = ("客户", "币种", "业务员", "数量", "计划发货日期")
DESCRIPTION = ("物料名称", "规格", "颜色", "面料", "面料-涤棉成分", "款式", "加标方式", "尺寸类型", "包装方式", "是否绣花")
REMARKS = ("表头备注", "行备注")
BUSINESS_FIELDS = (*HIGH_REVIEW, *DESCRIPTION, *REMARKS)
FORMATTED = ("币种", "数量", "计划发货日期")
# Currency names and what else they are called.
CURRENCY_ALIASES = {"usd": "美元", "us$": "美元", "美元": "美元", "cny": "人民币", "rmb": "人民币", "人民币": "人民币", "eur": "欧元", "欧元": "欧元", "gbp": "英镑", "英镑": "英镑", "jpy": "日元", "日元": "日元"}
INTERPRETATIONS = ("direct", "semantic", "source_summary")


def normalized_value(field: Column, value: Column) -> Column:
    """A value without differences of notation: white space and width; names of currencies; plain numbers; calendar dates."""
    aliases = F.create_map(*[F.lit(x) for pair in CURRENCY_ALIASES.items() for x in pair])
    pattern = r"^(\d{4})(?:-|/|年)(\d{1,2})(?:-|/|月)(\d{1,2})日?$"

    def number(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"(\.\d*?)0+$", "$1")
        return F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_replace(F.regexp_replace(plain, r"\.$", ""), r"^(-?)0+(?=\d)", "$1"))

    def date(text: Column) -> Column:
        parts = [F.lpad(F.regexp_extract(text, pattern, k), 2 if k > 1 else 4, "0") for k in (1, 2, 3)]
        return let(F.when(text.rlike(pattern), F.concat_ws("-", *parts)), lambda d: F.when(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull(), d))

    return let(
        master_text(value),
        lambda text: F.when(field == "币种", F.coalesce(F.try_element_at(aliases, F.lower(text)), text))
        .when(field == "数量", F.coalesce(number(text), text))
        .when(field == "计划发货日期", F.coalesce(date(text), text))
        .otherwise(text),
    )


def formal_value(field: Column, value: Column) -> Column:
    """The wording itself, but the normalised form of the three fields with a fixed format."""
    return F.when(field.isin(*FORMATTED), normalized_value(field, value)).otherwise(value)


def note_layout(value: Column) -> Column:
    """A note without punctuation and the space around it."""
    marks = r"[,;:!?.，；：！？。]"
    return F.regexp_replace(F.regexp_replace(master_text(value), rf"\s*({marks})\s*", "$1"), rf"{marks}+", "")


def bind(candidates: DataFrame, catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """candidates with the evidence they name: violation (null if sound), quote_evidence, quote_start and issue.

    candidates: record_id, field, value, interpretation, quote, references (array of evidence ids); catalog: evidence_id,
    scope_id, text; targets: record_id, scope_id, evidence_ids.  Unknown evidence, evidence of another scope and evidence
    that is not the target's are violations; a quotation that stands nowhere is an issue of the candidate alone.
    """
    keyed = candidates.withColumn("_c", F.struct("record_id", "field"))
    refs = keyed.select("record_id", "field", F.posexplode("references").alias("_at", "evidence_id")).join(targets, "record_id", "left")
    joined = refs.join(catalog.select("evidence_id", F.col("scope_id").alias("_scope"), "text"), "evidence_id", "left")
    wrong = F.when(F.col("_scope").isNull(), "evidence_id_missing").when(F.col("_scope") != F.col("scope_id"), "evidence_cross_scope").when(~F.array_contains("evidence_ids", F.col("evidence_id")), "evidence_not_in_target")
    per = joined.groupBy("record_id", "field").agg(F.min(F.struct(F.when(wrong.isNull(), 1).otherwise(0).alias("ok"), "_at", wrong.alias("violation"))).alias("_v"), F.array_sort(F.collect_list(F.struct("_at", "evidence_id", F.coalesce("text", F.lit("")).alias("text")))).alias("_snapshots"))
    out = keyed.drop("_c").join(per, ["record_id", "field"], "left")
    quote = F.lower(collapse(F.when(F.col("interpretation") == "direct", F.col("value")).otherwise(F.col("quote"))))
    found = F.get(F.filter(F.transform("_snapshots", lambda s: F.struct(s["evidence_id"].alias("evidence_id"), (F.position(quote, F.lower(collapse(s["text"]))) - 1).alias("start"))), lambda p: p["start"] >= 0), F.lit(0))
    found = F.when(quote != "", found)
    issue = (
        F.when((F.col("interpretation") == "direct") & found.isNull(), "direct_candidate_untraceable")
        .when((F.col("interpretation") != "direct") & (quote == ""), "supporting_quote_required")
        .when((F.col("interpretation") != "direct") & found.isNull(), "supporting_quote_untraceable")
    )
    violation = F.when(F.col("_v").isNull(), "evidence_id_missing").otherwise(F.col("_v.violation"))
    return out.withColumns({"violation": violation, "issue": issue, "quote_evidence": found["evidence_id"], "quote_start": found["start"]}).drop("_v", "_snapshots")


def decide(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """One decision per record and field: the candidate if it is sound, else the rule's value, else nothing.

    candidates: record_id, field, value, interpretation, quote, issue; rules: record_id, field, value, has_evidence, for
    every record and field.
    """
    c = candidates.select("record_id", "field", F.col("value").alias("ai"), "interpretation", "quote", "issue", F.lit(True).alias("_given"))
    both = rules.select("record_id", "field", F.col("value").alias("rule"), "has_evidence").join(c, ["record_id", "field"], "full_outer")
    field, given = F.col("field"), F.coalesce("_given", F.lit(False))
    remark = field.isin(*REMARKS)
    summary = F.col("interpretation") == "source_summary"
    issue = (
        F.when(F.col("issue").isNotNull(), "ai_candidate_content_issue")
        .when(summary & ~remark | ~F.coalesce(F.col("interpretation").isin(*INTERPRETATIONS), F.lit(False)), "ai_interpretation_not_allowed")
        .when(remark & summary & (note_layout(F.col("ai")) != note_layout(F.col("quote"))), "remark_expansion_rejected")
    )
    both = both.withColumn("problem", F.when(given, issue))
    chosen, ruled = given & F.col("problem").isNull(), F.coalesce(F.col("has_evidence"), F.lit(False))
    ai, rule = normalized_value(field, F.col("ai")), normalized_value(field, F.col("rule"))
    comparison = (
        F.when(chosen & ruled & (ai == rule) & (text_of(F.col("ai")) == text_of(F.col("rule"))), "agree")
        .when(chosen & ruled & (ai == rule), "equivalent_after_normalization")
        .when(chosen & ruled, "different")
        .when(chosen, "ai_only")
        .when(ruled, "python_fill")
        .otherwise("both_missing")
    )
    both = both.withColumn("comparison", comparison)
    interpreted = F.col("interpretation").isin("semantic", "source_summary")
    review = F.when(F.col("comparison").isin("agree", "equivalent_after_normalization", "ai_only"), interpreted).otherwise(True)
    high = field.isin(*HIGH_REVIEW)
    severity = F.when(~review, "none").when(high, "high").otherwise("medium")
    selected = F.when(chosen, F.concat(F.lit("ai_"), F.col("interpretation"), F.lit("_selected"))).when(ruled & F.col("problem").isNotNull(), "python_fallback_ai_issue").when(ruled, "python_fallback_ai_missing").otherwise("both_missing")
    why = {"agree": "ai_python_agree", "equivalent_after_normalization": "ai_python_normalized_equivalent", "different": "ai_python_different", "ai_only": "ai_only"}
    reason = None
    for name, code in why.items():
        reason = F.when(F.col("comparison") == name, code) if reason is None else reason.when(F.col("comparison") == name, code)
    return both.select(
        "record_id", "field",
        F.when(chosen, formal_value(field, F.col("ai"))).when(ruled, formal_value(field, F.col("rule"))).otherwise("").alias("value"),
        F.when(chosen, "ai_selected").when(ruled, "python_fallback").otherwise("missing").alias("status"),
        "comparison", review.alias("review_required"), severity.alias("severity"), F.array_compact(F.array(selected, F.when(chosen, reason).otherwise(F.col("problem")))).alias("reasons"),
    )


def decide_strict(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """The earlier policy: severe fields whose two directly evidenced values differ block the record.

    candidates: record_id, field, value, extraction_status, references; rules: record_id, field, value, has_evidence.
    """
    both = rules.select("record_id", "field", F.col("value").alias("rule"), "has_evidence").join(candidates.select("record_id", "field", F.col("value").alias("ai"), "extraction_status", "references"), ["record_id", "field"], "full_outer")
    ai, rule, field = text_of(F.col("ai")), text_of(F.col("rule")), F.col("field")
    taken = F.coalesce(F.col("extraction_status").isin("extracted", "normalized"), F.lit(False))
    refused = taken & (ai != "") & (((field == "数量") & ~ai.rlike(r"^\d+(\.\d+)?$")) | ((field == "计划发货日期") & ~ai.rlike(r"^\d{4}-\d{2}-\d{2}$")))
    failed = F.coalesce(F.col("extraction_status").isin("ambiguous", "invalid"), F.lit(False))
    direct, ruled = taken & (ai != "") & (F.coalesce(F.size("references"), F.lit(0)) > 0), F.coalesce(F.col("has_evidence"), F.lit(False))
    kept = F.when(rule != "", "python").otherwise("none")
    cases = [
        (refused, "ai_rejected_business_constraint", kept), (failed, "ai_contract_failure", kept), ((ai != "") & (rule != "") & (audit_text(ai) == audit_text(rule)), "ai_python_agree", F.lit("both")),
        ((ai != "") & (rule == ""), "ai_fills_python_blank", F.lit("ai")), ((rule != "") & (ai == ""), "python_retained_ai_omitted", F.lit("python")),
        (direct & ~ruled, "direct_evidence_selected_ai", F.lit("ai")), (ruled & ~direct, "direct_evidence_selected_python", F.lit("python")),
        (direct & ruled, "unresolved_direct_evidence_conflict", F.lit("none")), ((ai == "") & (rule == ""), "both_missing", F.lit("none")), (F.lit(True), "no_direct_evidence_conflict", F.lit("none")),
    ]
    reason = source = None
    for condition, name, from_ in cases:
        reason = F.when(condition, name) if reason is None else reason.when(condition, name)
        source = F.when(condition, from_) if source is None else source.when(condition, from_)
    out = both.withColumns({"reason": reason, "source": source})
    severe = field.isin(*HIGH_REVIEW) & (F.col("source") == "none") & F.col("reason").isin("ai_rejected_business_constraint", "ai_contract_failure", "unresolved_direct_evidence_conflict")
    return out.select("record_id", "field", F.when(F.col("source").isin("python", "both"), rule).when(F.col("source") == "ai", ai).otherwise("").alias("value"), "source", "reason", severe.alias("blocking"))


def ready_gate(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per record: ready if each of the business fields is decided once; the reasons if not."""
    got = decisions.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("field").alias("fields"), F.bool_or("review_required").alias("review_required"))
    joined = expected.select("record_id").distinct().join(got.withColumn("_got", F.lit(True)), "record_id", "full_outer").join(expected.select("record_id").distinct().withColumn("_wanted", F.lit(True)), "record_id", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_got").isNull(), "record_missing"),
            F.when(F.col("_wanted").isNull(), "record_unknown"),
            F.when(F.col("fields") < len(BUSINESS_FIELDS), "fields_missing"),
            F.when(F.col("n") > F.col("fields"), "fields_repeated"),
        )
    )
    return joined.select("record_id", reasons.alias("reasons"), F.coalesce("review_required", F.lit(False)).alias("review_required")).withColumn("ready", F.size("reasons") == 0)


def wide_records(decisions: DataFrame) -> DataFrame:
    """One row per record with the business fields as columns."""
    return decisions.groupBy("record_id").pivot("field", list(BUSINESS_FIELDS)).agg(F.first("value"))


def review_items(decisions: DataFrame) -> DataFrame:
    """What a reviewer sees, the severe first within what needs review."""
    place = F.array_position(F.array(*[F.lit(f) for f in BUSINESS_FIELDS]), F.col("field"))
    return decisions.orderBy(~F.col("review_required"), F.col("severity") != "high", "record_id", place)
