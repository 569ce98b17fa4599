"""Field-by-field comparison of orders with candidates, and the blended score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.contracts import FIELD_WEIGHTS, HARD_FIELDS, STATUS_SCORES, STRUCTURED_SHARE, VECTOR_SHARE
from weftspark.functions import fields as N
from weftspark.functions import sizes as S
from weftspark.functions.text import audit_text, master_text
from weftspark.functions.vectors import score_of
from weftspark.operators.summary import weighted_mean

COMPARED = ("product_category", "spec", "color", "fabric", "composition", "density", "style", "label_method", "size_type")


def prepared(df: DataFrame, prefix: str) -> DataFrame:
    """df with everything that comparison needs of a row, under names with the prefix: computed once a row, not once a pair.

    df has the compared fields as text, and fabric_category, which stands for fabric where it is filled.
    """
    text = {f: F.coalesce(F.col(f), F.lit("")) for f in (*COMPARED, "fabric_category")}
    fabric = F.when(text["fabric_category"] != "", text["fabric_category"]).otherwise(text["fabric"])
    text["fabric"] = fabric
    size = S.size_of(text["spec"])
    compact = F.replace(F.regexp_replace(F.replace(audit_text(text["spec"]), F.lit(" "), F.lit("")), "[×x]", "*"), F.lit(" "), F.lit(""))
    key = {
        "product_category": master_text(text["product_category"]), "color": N.master_color(text["color"]), "composition": N.master_composition(text["composition"]),
        "density": N.master_density(text["density"]), "fabric": S.fabric_family(fabric), "style": master_text(text["style"]), "label_method": master_text(text["label_method"]),
        "size_type": master_text(text["size_type"]), "spec": compact,
    }
    out = df.withColumns({f"{prefix}{f}_raw": text[f] for f in COMPARED} | {f"{prefix}{f}_text": master_text(text[f]) for f in COMPARED} | {f"{prefix}{f}_key": key[f] for f in COMPARED})
    out = out.withColumn(f"{prefix}size", size).withColumn(f"{prefix}features", S.style_features(F.col(f"{prefix}style_text")))
    return out


def field_status(field: str, q: str, c: str) -> Column:
    """How the query's and the candidate's field compare."""
    col = lambda side, what: F.col(f"{side}{field}_{what}")
    missing = F.when(col(q, "text") == "", "missing_query").when(col(c, "text") == "", "missing_candidate")
    keys = (col(q, "key") == "") | (col(c, "key") == "")
    same = col(q, "key") == col(c, "key")
    if field == "spec":
        a, b = F.col(f"{q}size"), F.col(f"{c}size")
        low = lambda s: F.least(s["first"], s["second"])
        high = lambda s: F.greatest(s["first"], s["second"])
        near = lambda x, y: F.abs(x - y) <= 0.01
        base = near(low(a), low(b)) & near(high(a), high(b))
        ours, theirs = a["extension"] != 0, b["extension"] != 0
        return (
            missing.when(a["first"].isNull() | b["first"].isNull(), "not_comparable")
            .when(~base, "hard_conflict")
            .when(ours & theirs & ~near(a["extension"], b["extension"]), "no_match")
            .when(ours != theirs, "partial_match")
            .when(same, "exact_match")
            .otherwise("equivalent_match")
        )
    if field == "style":
        shared = F.size(F.array_intersect(f"{q}features", f"{c}features")) > 0
        none = (F.size(f"{q}features") == 0) | (F.size(f"{c}features") == 0)
        return missing.when(col(q, "text") == col(c, "text"), "exact_match").when(none, "not_comparable").when(shared, "partial_match").otherwise("no_match")
    if field in ("product_category", "label_method", "size_type"):
        exact = col(q, "raw") == col(c, "raw")
    elif field == "fabric":
        exact = F.lower(col(q, "text")) == F.lower(col(c, "text"))
    else:
        exact = col(q, "text") == col(c, "text")
    different = "hard_conflict" if field in HARD_FIELDS else "no_match"
    return missing.when(keys, "not_comparable").when(~same, different).when(exact, "exact_match").otherwise("equivalent_match")


def status_score(status: Column) -> Column:
    out = None
    for name, score in STATUS_SCORES.items():
        value = F.lit(score).cast("double")
        out = F.when(status == name, value) if out is None else out.when(status == name, value)
    return out


def evaluated(pairs: DataFrame, q: str, c: str, similarity: str) -> DataFrame:
    """pairs of prepared rows with fields (struct of statuses), conflicts, structured_score, comparable_fields,
    vector_score and match_score."""
    out = pairs.withColumn("fields", F.struct(*[field_status(f, q, c).alias(f) for f in COMPARED]))
    score, count = weighted_mean([(status_score(F.col("fields")[f]), w) for f, w in FIELD_WEIGHTS.items()])
    conflicts = F.array_compact(F.array(*[F.when(F.col("fields")[f] == "hard_conflict", f) for f in HARD_FIELDS]))
    out = out.withColumns({"conflicts": conflicts, "structured_score": score, "comparable_fields": count, "vector_score": score_of(F.col(similarity))})
    blend = F.round(STRUCTURED_SHARE * F.col("structured_score") + VECTOR_SHARE * F.col("vector_score"), 6)
    return out.withColumn("match_score", F.coalesce(blend, F.col("vector_score")))
