"""Aggregates on small tables."""

import statistics

from pyspark.sql import functions as F

from weftspark.operators import summary


def test_five_numbers_are_exact(spark):
    values = [((i * 7919) % 1009) / 7 for i in range(3000)]
    rows = [("a", v) for v in values] + [("b", 1.0), ("c", 2.0), ("c", 4.0), (None, 5.0), ("a", None)] + [("d", 3.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in summary.five_numbers(df, ["k"], "v").collect()}
    q = statistics.quantiles(values, n=4, method="inclusive")
    assert [got["a"].q1, got["a"].median, got["a"].q3] == [round(x, 6) for x in q] and got["a"]["count"] == 3000
    assert (got["b"].min, got["b"].q1, got["b"].max) == (1, 1, 1) and (got["c"].q1, got["c"].median, got["c"].q3) == (2.5, 3, 3.5)
    assert got[None].median == 5 and (got["d"].q1, got["d"].q3, got["d"]["count"]) == (3, 3, 50)
    assert summary.five_numbers(df, [], "v").first()["count"] == 3054 and summary.five_numbers(df.limit(0), ["k"], "v").count() == 0


def test_audit_counts_and_rates(spark):
    df = spark.createDataFrame([("a", ""), ("a", "x"), (None, "x"), ("b", None)], "k string, v string")
    got = {r.column_name: r for r in summary.column_audit(df, ["k", "v"]).collect()}
    assert (got["k"].row_count, got["k"].empty_count, got["k"].distinct_count, got["k"].repeated) == (4, 1, 3, 1) and got["v"].empty_count == 2
    ranks = spark.createDataFrame([(1,), (3,), (11,), (None,)], "r int")
    row = summary.hit_rates(ranks.withColumn("g", F.lit(1)), ["g"], "r", (1, 3, 10)).first()
    assert (row.reviewed, row.top1_hits, row.top3_rate, row.outside) == (4, 1, 0.5, 2)
    totals = {(r.field, r.i): r.n for r in summary.conflict_counts(spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "i int, c array<string>"), "i", "c").collect()}
    assert totals == {("x", 1): 1, ("x", 2): 1, ("y", 1): 1, ("x", None): 2, ("y", None): 1}
    assert summary.weighted_mean([(F.lit(1.0), 0.5), (F.lit(None).cast("double"), 0.3), (F.lit(0.0), 0.5)])[0] is not None
