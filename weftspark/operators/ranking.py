"""Ranks with tolerated ties, margins, decisions and groups of equal candidates, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.contracts import LEAST_COMPARABLE_FIELDS, TIE


def numbered(df: DataFrame, by: list[str], score: str, tie_break: list[str], name: str = "ordinal") -> DataFrame:
    """df with each row's place by descending score within `by`; tie_break makes it unique."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie_break)
    return df.withColumn(name, F.row_number().over(order))


def island_rank(df: DataFrame, by: list[str], score: str, ordinal: str = "ordinal", tie: float = TIE, name: str = "rank") -> DataFrame:
    """Competition rank in which a row whose score is close to the row before has that row's rank, so ties chain."""
    order = Window.partitionBy(*by).orderBy(ordinal)
    gap = F.lag(score).over(order) - F.col(score)
    apart = F.when(gap.isNull() | (F.abs(gap) > tie), F.col(ordinal))
    return df.withColumn(name, F.last(apart, ignorenulls=True).over(order))


def top_margin(df: DataFrame, by: list[str], score: str, ordinal: str = "ordinal") -> DataFrame:
    """One row per `by`: the best score and its lead over the second, null if there is no second."""
    best, second = (F.max(F.when(F.col(ordinal) == n, F.col(score))) for n in (1, 2))
    return df.groupBy(*by).agg(best.alias("top1_score"), F.round(best - second, 6).alias("top1_margin"), F.count(F.lit(1)).alias("candidates"))


def decision(candidates: Column, comparable: Column, in_duplicate_group: Column, margin: Column) -> Column:
    """Outcome for a query from its number of candidates and its leading candidate."""
    return (
        F.when(candidates == 0, "no_candidate")
        .when(comparable < LEAST_COMPARABLE_FIELDS, "insufficient_evidence")
        .when(in_duplicate_group, "ambiguous_tie")
        .when(margin.isNotNull() & (F.abs(margin) <= TIE), "ambiguous_tie")
        .when((candidates == 1) | (margin > TIE), "unique_best_candidate")
        .otherwise("ranked_candidates")
    )


def duplicate_groups(df: DataFrame, by: list[str], text: str, score: str | None = None, fields: tuple[str, ...] = (), code: str | None = None) -> DataFrame:
    """Groups of rows with the same text (and scores that agree), with the fields in which members are the same or differ."""
    aggregates = [F.count(F.lit(1)).alias("duplicate_group_size")]
    if code:
        aggregates.append(F.array_sort(F.collect_set(code)).alias("duplicate_material_codes"))
    if score:
        aggregates += [F.min(score).alias("_low"), F.max(score).alias("_high")]
    aggregates += [F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_n_{f}") for f in fields]
    groups = df.groupBy(*by, text).agg(*aggregates).filter("duplicate_group_size > 1")
    if score:
        groups = groups.filter(F.col("_high") - F.col("_low") <= TIE).drop("_low", "_high")
    if fields:
        named = lambda same: F.array_compact(F.array(*[F.when((F.col(f"_n_{f}") == 1) == same, f) for f in fields]))
        groups = groups.withColumns({"identical_fields": named(True), "differing_fields": named(False)}).drop(*[f"_n_{f}" for f in fields])
    return groups


def resolve_by_priority(df: DataFrame, by: list[str], priority: str, value: str) -> DataFrame:
    """Of each `by` the value with the smallest priority; ambiguous if several values, case ignored, share it."""
    lowest = df.groupBy(*by).agg(F.min(priority).alias(priority))
    leading = df.join(lowest, [*by, priority])
    return leading.groupBy(*by).agg(
        F.min(priority).alias("priority"),
        F.when(F.count_distinct(F.lower(value)) == 1, F.min(value)).otherwise("").alias("value"),
        F.when(F.count_distinct(F.lower(value)) == 1, "normalized").otherwise("ambiguous").alias("status"),
    )
