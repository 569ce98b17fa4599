"""Reference dictionaries: matching by attributes and keywords, comparison with the rules' values, what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions.text import audit_text, first_case, let
from weftspark.operators.recall import in_blocks

# Statuses of a dictionary comparison, the order in which fabric attributes narrow a search, and thresholds.
STATUSES = ("exact_match", "equivalent_match", "partial_match", "more_specific", "ambiguous", "conflict", "dictionary_no_match", "source_not_provided")
FABRIC_ORDER = ("category", "composition", "density", "yarn_count", "construction", "weave", "stripe_width", "color")
ACTIONS = ("keep_python", "keep_default", "propose_replace_default", "propose_fill", "propose_enrich", "manual_review")
EMPTY_STATUSES = ("unrecognized", "source_not_provided")


def color_candidates(text: Column) -> Column:
    """The standard colours that a text names, in order."""
    return let(audit_text(text), colors_in)


def colors_in(low: Column) -> Column:
    """color_candidates of a text that audit_text has been through."""
    return F.array_compact(F.array(
        F.when(low.rlike(r"(?U)\bwhite\b|漂白|本白"), "漂白色"), F.when(low.rlike(r"(?U)\bgr[ae]y\b|灰"), "灰色"), F.when(low.rlike(r"(?U)\bblue\b|蓝"), "蓝色"), F.when(low.rlike(r"(?U)\bbeige\b|米"), "米色"),
    ))


def match_fabrics(queries: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """key and source_row of the dictionary rows that agree in every attribute that the query has.

    queries: key, components map<string,string>; dictionary: source_row, components.  The category, where the query has one,
    is the join key; the others meet the dictionary block by block.  Catalyst broadcasts a dictionary that is small enough.
    """
    value = lambda side, k: F.coalesce(F.try_element_at(F.col(side), F.lit(k)), F.lit(""))
    q = queries.select(key, F.col("components").alias("_q"), value("components", "category").alias("_category"))
    d = dictionary.select("source_row", F.col("components").alias("_d"), value("components", "category").alias("_category"))
    fits = F.lit(True)
    for k in FABRIC_ORDER[1:]:
        fits = fits & ((value("_q", k) == "") | (value("_q", k) == value("_d", k)))
    named = q.filter("_category <> ''").join(d, "_category").filter(fits)
    rest = in_blocks(d.drop("_category"), q.filter("_category = ''"), key, fits)
    return named.select(key, "source_row").unionByName(rest.select(key, "source_row"))


def match_keywords(rows: DataFrame, rules: DataFrame, text: str, keyword: str) -> DataFrame:
    """rows with each rule whose keyword their text has (case ignored); the rules meet the rows block by block."""
    return in_blocks(rules, rows, text, F.contains(F.lower(F.col(text)), F.lower(F.col(keyword))))


def single_candidate(candidates: Column, value: Column) -> Column:
    """Status of a field whose dictionary candidates are an array, against the rules' value."""
    one = F.array_distinct(F.filter(candidates, lambda c: F.trim(c) != ""))
    first = F.get(one, F.lit(0))
    return first_case(
        (F.size(one) == 0, "dictionary_no_match"), (F.size(one) > 1, "ambiguous"), (first == value, "exact_match"), (audit_text(first) == audit_text(value), "equivalent_match"), otherwise="conflict",
    )


def integration_action(status: Column, value: Column, value_status: Column, candidates: Column, source_text: Column, source_cells: Column, matched: Column, missing: Column, conflicting: Column) -> Column:
    """What a comparison would change in a record, as a struct of action and candidate; nothing is written back."""
    filled = lambda a: F.array_distinct(F.filter(a, lambda c: F.trim(c) != ""))
    one = filled(candidates)
    unique = F.when(F.size(one) == 1, one[0]).otherwise("")
    source = (F.trim(F.coalesce(source_text, F.lit(""))) != "") & (F.size(filled(source_cells)) > 0)
    safe = (unique != "") & source
    defaulted, empty = value_status == "defaulted", (F.trim(value) == "") | value_status.isin(*EMPTY_STATUSES)
    complete = source & (F.size(matched) > 0) & (F.size(missing) == 0) & (F.size(conflicting) == 0)
    action = first_case(
        (status.isin("ambiguous", "conflict"), "manual_review"),
        (status.isin("dictionary_no_match", "source_not_provided") & defaulted, "keep_default"),
        (status.isin("dictionary_no_match", "source_not_provided"), "keep_python"),
        (defaulted & safe, "propose_replace_default"), (defaulted, "keep_default"),
        (empty & safe, "propose_fill"), (empty, "keep_python"),
        (status.isin("exact_match", "equivalent_match"), "keep_python"),
        ((unique != "") & complete, "propose_enrich"), otherwise="keep_python",
    )
    keeps = (action == "keep_python") & (status.isin("exact_match", "equivalent_match")) & ~empty & ~defaulted
    chosen = F.when(action.isin("manual_review", "propose_replace_default", "propose_fill", "propose_enrich") | keeps, unique).otherwise("")
    return F.struct(action.alias("action"), chosen.alias("candidate"))


def risk_levels(comparisons: DataFrame, field: str = "field", status: str = "status") -> DataFrame:
    """Per field: counts by status, verified share, and how risky it is to rely on the dictionary."""
    counts = comparisons.groupBy(field).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in STATUSES])
    verified = F.col("exact_match") + F.col("equivalent_match")
    share, manual = F.try_divide(verified, "total"), F.col("ambiguous") + F.col("conflict")
    low = (share >= 0.90) & (manual == 0) & (F.col("partial_match") == 0) & (F.col("dictionary_no_match") <= 3) & (F.col("source_not_provided") == 0)
    level = first_case(
        ((share < 0.60) | ((F.col("source_not_provided") >= 25) & (verified < 20)), "not_ready"),
        (((share < 0.80) | (F.col("dictionary_no_match") >= 10)) & (F.col(field) == "币种") & (manual == 0), "medium_risk"),
        ((share < 0.80) | (F.col("dictionary_no_match") >= 10), "high_risk"), (low, "low_risk"), otherwise="medium_risk",
    )
    return counts.withColumns({"verified_share": F.round(share, 6), "risk": level})


def validation_action(status: Column) -> Column:
    """Keep the value where the dictionary agrees or has nothing to say, else let a person look."""
    return F.when(status.isin("exact_match", "equivalent_match", "dictionary_no_match", "source_not_provided"), "keep").otherwise("manual_review")


def evidence_text(references: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """The texts at a list of cells, each once in the list's order, joined by a bar.

    references: key columns, file, sheet_idx and refs (array of A1 coordinates); cells: file, sheet_idx, ref, text.
    """
    wanted = references.select(*key, "file", "sheet_idx", F.posexplode("refs").alias("_at", "ref"))
    found = wanted.join(cells.select("file", "sheet_idx", "ref", "text"), ["file", "sheet_idx", "ref"]).filter("text <> ''")
    ordered = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_t"))
    return ordered.select(*key, F.array_join(F.array_distinct(F.transform("_t", lambda t: t["text"])), " | ").alias("source_text"))
