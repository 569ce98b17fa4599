"""Formal records against the material master: recall, comparison, ranking, decision, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.contracts import COMPARISON_STATUSES
from weftspark.functions import fields as N
from weftspark.functions import sizes as S
from weftspark.functions.text import master_text
from weftspark.operators import ranking, recall, scoring, summary
from weftspark.operators.master import labelled_text
from weftspark.session import stored

# Labels of the fields in a query's text, in order; a query's colon is wide, a document's is not.
QUERY_LABELS = {
    "品类": "product_category", "规格": "spec", "颜色": "color", "面料": "fabric", "面料品类": "fabric_category", "密度": "density", "成分": "composition",
    "款式": "style", "加标方式": "label_method", "尺寸类型": "size_type", "工艺备注": "line_note",
}
OPEN_FIELDS = ("color", "density", "composition", "size_type")
TOO_MANY = 100


@dataclass(frozen=True)
class Matches:
    candidates: DataFrame  # order_id, rank, material_code, scores, fields
    decisions: DataFrame  # one row per order
    conflicts: DataFrame  # removed candidates per field, per order and overall


def order_queries(records: DataFrame, key: str = "order_id") -> DataFrame:
    """One query per formal record (struct column `record`): material fields and the text to encode."""
    r = F.col("record")
    fabric = master_text(r["面料"])
    given = r["面料-涤棉成分"]
    out = records.select(
        key,
        N.master_category(r["物料名称"]).alias("product_category"), master_text(r["规格"]).alias("spec"), N.master_color(r["颜色"]).alias("color"), fabric.alias("fabric"),
        S.fabric_family(fabric).alias("fabric_category"), N.master_density(S.thread_density(fabric)).alias("density"),
        N.master_composition(F.when(given != "", given).otherwise(S.text_composition(fabric))).alias("composition"),
        master_text(r["款式"]).alias("style"), master_text(r["加标方式"]).alias("label_method"), master_text(r["尺寸类型"]).alias("size_type"), master_text(r["行备注"]).alias("line_note"),
    )
    return out.withColumn("query_text", labelled_text(QUERY_LABELS, "："))


def match_orders(queries: DataFrame, master: DataFrame, query_vectors: DataFrame, master_vectors: DataFrame, top_k: int = 10, recall_k: int = 300) -> Matches:
    """Ranked candidates for every query.

    queries: order_id and the query fields; master: material_code and its fields; vectors: the id and `vector`.  Only
    materials with a vector are candidates.
    """
    if top_k < 10 or recall_k <= 0:
        raise ValueError("top_k is 10 at least, recall_k 1 at least")
    queries = stored(queries, "queries")
    indexed = recall.indexed(master, master_vectors, "material_code")
    structured = recall.structured_recall(queries, indexed, "order_id", "product_category", OPEN_FIELDS, "material_code")
    by_vector = recall.vector_topk(
        query_vectors.select(F.col("order_id").alias("query_id"), "vector"), master_vectors.select(F.col("material_code").alias("item_id"), "vector"), recall_k
    ).select(F.col("query_id").alias("order_id"), F.col("item_id").alias("material_code"), "similarity")
    by_vector = stored(by_vector, "recall")
    union = recall.union_recall(structured, by_vector, "order_id", "material_code")
    # written out, so that each row is prepared once and not once a pair
    q = scoring.prepared(queries, "q_").select("order_id", *[c for f in scoring.COMPARED for c in (f"q_{f}_raw", f"q_{f}_text", f"q_{f}_key")], "q_size", "q_features")
    q = stored(q, "prepared-queries")
    m = scoring.prepared(indexed, "m_").select("material_code", "document_text", *scoring.COMPARED, "fabric_category", *[c for f in scoring.COMPARED for c in (f"m_{f}_raw", f"m_{f}_text", f"m_{f}_key")], "m_size", "m_features")
    m = stored(m, "prepared-master")
    pairs = union.join(by_vector, ["order_id", "material_code"], "left")
    pairs = recall.backfilled(pairs, query_vectors, master_vectors, "order_id", "material_code")
    scored = scoring.evaluated(pairs.join(q, "order_id").join(m, "material_code"), "q_", "m_", "similarity")
    kept_fields = (*scoring.COMPARED, "fabric_category")
    scored = scored.select("order_id", "material_code", "sources", "first_source", "similarity", "document_text", *kept_fields, "fields", "conflicts", "structured_score", "comparable_fields", "vector_score", "match_score")
    scored = stored(scored, "scored")
    left = scored.filter(F.size("conflicts") == 0)
    groups = ranking.duplicate_groups(left, ["order_id"], "document_text", score="match_score", fields=kept_fields, code="material_code")
    ranked = ranking.numbered(left, ["order_id"], "match_score", ["first_source", "material_code"])
    ranked = ranked.join(groups, ["order_id", "document_text"], "left")
    ranked = stored(ranked, "ranked")
    top = ranking.island_rank(ranked.filter(F.col("ordinal") <= top_k), ["order_id"], "match_score")
    return Matches(top.drop(*kept_fields), decided(queries, scored, ranked), summary.conflict_counts(scored, "order_id", "conflicts"))


def decided(queries: DataFrame, scored: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per order: counts of the recall, leading scores, decision."""
    counts = scored.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("union_candidates"),
        F.count_if((F.col("sources") == 2) | (F.col("first_source") == 0)).alias("structured_candidates"),
        F.count_if((F.col("sources") == 2) | (F.col("first_source") == 1)).alias("vector_candidates"),
        F.count_if(F.size("conflicts") > 0).alias("removed"),
    )
    margins = ranking.top_margin(ranked, ["order_id"], "match_score")
    leading = ranked.filter("ordinal = 1").select("order_id", F.col("material_code").alias("top_code"), F.col("comparable_fields").alias("comparable"), F.col("duplicate_group_size").isNotNull().alias("duplicate"))
    out = queries.select("order_id").join(counts, "order_id", "left").join(margins, "order_id", "left").join(leading, "order_id", "left")
    out = out.fillna(0, ["union_candidates", "structured_candidates", "vector_candidates", "removed", "candidates", "comparable"]).fillna(False, ["duplicate"])
    return out.withColumn("decision", ranking.decision(F.col("candidates"), F.col("comparable"), F.col("duplicate"), F.col("top1_margin"))).withColumn("action", F.lit("manual_review"))


def summarized(matches: Matches) -> dict[str, DataFrame]:
    """Aggregates over all orders: decisions, score distributions, field statuses among the candidates, mean counts."""
    d = matches.decisions
    fields = matches.candidates.select(F.explode(F.create_map(*[x for f in scoring.COMPARED for x in (F.lit(f), F.col("fields")[f])])).alias("field", "status"))
    counts = ("structured_candidates", "vector_candidates", "union_candidates", "removed", "candidates")
    return {
        "decisions": d.groupBy("decision").agg(F.count(F.lit(1)).alias("orders")),
        "top1_score": summary.five_numbers(d, [], "top1_score"),
        "top1_margin": summary.five_numbers(d, [], "top1_margin"),
        "field_statuses": summary.status_matrix(fields, "field", "status", COMPARISON_STATUSES),
        "conflicts": matches.conflicts.filter("order_id is null").select("field", "n"),
        "averages": d.agg(*[F.round(F.avg(c), 3).alias(c) for c in counts], F.count_if(F.col("candidates") > TOO_MANY).alias("too_many"), F.count_if("duplicate").alias("ambiguous_duplicate")),
    }
