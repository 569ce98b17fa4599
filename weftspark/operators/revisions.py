"""Revisions of decided records: append-only, each on top of the one before, current values by the highest number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators.resolution import BUSINESS_FIELDS, formal_value
from weftspark.operators.states import latest

SCHEMA = "history string, number long, revision string, parent string, record_id string, field string, value string, action string"
ACTIONS = ("choose_ai", "choose_python", "enter_value", "confirm")


class RevisionConflict(ValueError):
    """The history moved on, or the request breaks its rules."""


def start(spark, histories: DataFrame) -> DataFrame:
    """Revision 0 of every history: no change yet."""
    none = F.lit(None).cast("string")
    revision = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("start\n"), F.col("history")), 256))
    return histories.select("history", F.lit(0).cast("long").alias("number"), revision.alias("revision"), none.alias("parent"), none.alias("record_id"), none.alias("field"), none.alias("value"), F.lit("start").alias("action"))


def append(revisions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New revisions, and requests that are refused with the reason.

    requests: history, expected (the revision the editor saw), record_id, field, value, action.  A request on top of the
    current revision becomes the next one.  The very request that made the current revision is repeated without effect.
    Of several requests on the same revision the first by its identity wins.
    """
    head = latest(revisions, ["history"], ["number"], ["number", "revision", "parent"]).select("history", "number", "revision", "parent")
    identity = F.sha2(F.concat_ws("\n", "history", "expected", "record_id", "field", "value", "action"), 256)
    asked = requests.withColumn("_id", F.concat(F.lit("sha256:"), identity)).join(head, "history", "left")
    refusal = (
        F.when(F.col("revision").isNull(), "unknown_history")
        .when(~F.col("field").isin(*BUSINESS_FIELDS), "field_not_editable")
        .when(~F.col("action").isin(*ACTIONS), "unknown_action")
        .when(F.col("_id") == F.col("revision"), "already_applied")
        .when(F.col("expected") != F.col("revision"), "history_moved_on")
    )
    asked = asked.withColumn("reason", refusal)
    first = asked.filter("reason is null").groupBy("history").agg(F.min("_id").alias("_first"))
    asked = asked.join(first, "history", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_id") != F.col("_first")), "history_moved_on").otherwise(F.col("reason")))
    new = asked.filter("reason is null").dropDuplicates(["_id"])
    value = formal_value(F.col("field"), F.col("value"))
    rows = new.select("history", (F.col("number") + 1).alias("number"), F.col("_id").alias("revision"), F.col("revision").alias("parent"), "record_id", "field", value.alias("value"), "action")
    return rows, asked.filter("reason is not null").select(*requests.columns, "reason")


def current_values(decisions: DataFrame, revisions: DataFrame) -> DataFrame:
    """Decisions with the latest revised value where there is one; a revised field needs no more review."""
    edits = latest(revisions.filter("field is not null"), ["record_id", "field"], ["number"], ["value"]).select("record_id", "field", F.col("value").alias("_new"))
    out = decisions.join(edits, ["record_id", "field"], "left")
    changed = F.col("_new").isNotNull()
    return out.withColumns({"value": F.coalesce("_new", "value"), "review_required": F.col("review_required") & ~changed, "severity": F.when(changed, "none").otherwise(F.col("severity")), "status": F.when(changed, "revised").otherwise(F.col("status"))}).drop("_new")


def review_summary(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count_if("review_required").alias("review_required"), F.count_if(F.col("review_required") & (F.col("severity") == "high")).alias("high"), F.count_distinct("record_id").alias("records"))
