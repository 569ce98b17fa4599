"""Aggregates: audits, distributions, status matrices, hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_audit(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """One row per column: rows, empty values and distinct values; and how many rows repeat a key that is not empty."""
    value = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(value[c] == "").alias(f"e_{i}") for i, c in enumerate(columns)],
    )
    distinct = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), value[c].alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = distinct.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum(F.when(F.col("value") != "", F.col("n") - 1).otherwise(0)).alias("repeated"))
    empties = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"e_{i}").alias("empty_count")) for i, c in enumerate(columns)])).alias("x")).select(F.col("n").alias("row_count"), "x.*")
    out = empties.join(counts, "column_name", "left").select("column_name", "row_count", "empty_count", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), F.coalesce("repeated", F.lit(0)).alias("repeated"))
    return out.withColumn("is_key", F.col("column_name") == F.lit(key)) if key else out


def row_audit(df: DataFrame, columns: list[str], key: str, width: str | None = None, wanted_width: int | None = None) -> DataFrame:
    """One row: rows, values of the key that repeat, rows that repeat as a whole, and rows of another width than wanted."""
    same = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    filled = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    keys = filled.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    odd = F.count_if(F.col(width) != wanted_width) if width else F.lit(0).cast("bigint")
    one = df.agg(F.count(F.lit(1)).alias("rows"), odd.alias("invalid_width"))
    for part in (keys, same):  # one row each
        one = one.withColumn("_", F.lit(1)).join(part.withColumn("_", F.lit(1)), "_").drop("_")
    return one


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values that are not empty, equal counts by value: a top-k report."""
    return df.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


#: Accuracy of the sketch that brackets a quantile; the bracket is twice as wide as its error.
SKETCH = 10_000


def five_numbers(df: DataFrame, by: list[str], value: str, places: int = 6) -> DataFrame:
    """Count, extremes and inclusive quartiles per group, exact.

    A sketch brackets each quartile; only the few values inside a bracket are ranked, and those below are counted.  So no
    task holds the values of a whole group.
    """
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")  # so that null keys join
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), key.alias("_k"))
    edges = [F.lit(min(1.0, max(0.0, q + d))) for q in quartiles.values() for d in (-2 / SKETCH, 2 / SKETCH)]
    keys = ["_k"]
    groups = rows.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in by], F.count(F.lit(1)).alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.percentile_approx("_v", F.array(*edges), F.lit(SKETCH)).alias("_b"))
    marked = rows.join(groups.select(*keys, "_b"), keys)
    outside = []
    for i, n in enumerate(quartiles):
        low, high = F.col("_b")[2 * i], F.col("_b")[2 * i + 1]
        outside += [F.count_if(F.col("_v") < low).alias(f"_below_{n}"), F.max(F.when(F.col("_v") < low, F.col("_v"))).alias(f"_before_{n}"), F.min(F.when(F.col("_v") > high, F.col("_v"))).alias(f"_behind_{n}")]
    below = marked.groupBy(*keys).agg(*outside)
    inside = F.array_compact(F.array(*[F.when(F.col("_v").between(F.col("_b")[2 * i], F.col("_b")[2 * i + 1]), F.lit(n)) for i, n in enumerate(quartiles)]))
    near = marked.withColumn("_q", F.explode(inside)).groupBy(*keys, "_q", "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = near.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_v")))
    joined = near.join(groups.select(*keys, "count").join(below, keys), keys)
    at = []
    for n, q in quartiles.items():
        for side, f in (("low", F.floor), ("high", F.ceil)):
            place = f((F.col("count") - 1) * q)
            first = F.min(F.when((F.col("_q") == n) & (F.col("_upto") + F.col(f"_below_{n}") > place), F.col("_v")))
            before = F.min(F.when(place < F.col(f"_below_{n}"), F.col(f"_before_{n}")))  # the place may be next to the bracket
            at.append(F.coalesce(before, first, F.min(f"_behind_{n}")).alias(f"{n}_{side}"))
    out = groups.join(joined.groupBy(*keys).agg(*at), keys)
    between = lambda n, q: F.round(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * ((F.col("count") - 1) * q - F.floor((F.col("count") - 1) * q)), places).alias(n)
    return out.select(*by, "count", F.round("min", places).alias("min"), *[between(n, q) for n, q in quartiles.items()], F.round("max", places).alias("max"))


def status_matrix(df: DataFrame, field: str, status: str, statuses: tuple[str, ...]) -> DataFrame:
    """One row per field with a count for every status, zero where it doesn't occur."""
    return df.groupBy(field).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def conflict_counts(df: DataFrame, by: str, conflicts: str) -> DataFrame:
    """Counts of each named conflict per record, and over all records (record null)."""
    return df.select(by, F.explode(conflicts).alias("field")).rollup("field", by).agg(F.count(F.lit(1)).alias("n")).filter("field is not null")


def hit_rates(df: DataFrame, by: list[str], rank: str, cuts: tuple[int, ...]) -> DataFrame:
    """Hits within the first k ranks, and their share of all rows; null without rows."""
    hits = [F.count_if(F.col(rank) <= k) for k in cuts]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reviewed"),
        *[h.alias(f"top{k}_hits") for h, k in zip(hits, cuts, strict=True)],
        *[F.round(F.try_divide(h, F.count(F.lit(1))), 6).alias(f"top{k}_rate") for h, k in zip(hits, cuts, strict=True)],
        F.count_if(F.col(rank).isNull() | (F.col(rank) > max(cuts))).alias("outside"),
    )


def weighted_mean(parts: list[tuple[Column, float]], places: int = 6) -> tuple[Column, Column]:
    """Mean of the scores that are not null by their weights (null if there is none), and their number."""
    total, weight, count = F.lit(0.0), F.lit(0.0), F.lit(0)
    for score, w in parts:
        total = total + F.coalesce(score * w, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), w).otherwise(0.0)
        count = count + F.when(score.isNotNull(), 1).otherwise(0)
    return F.when(weight > 0, F.round(total / weight, places)), count
