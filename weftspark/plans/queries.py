"""The library's operators applied to the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.functions import text as X
from weftspark.functions import vectors as V
from weftspark.operators import contracts, items, metadata, ranking, recall, sheets, states, summary
from weftspark.sources import documents
from weftspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# ---- vectors and recall

@query("""
SELECT query_id, item_id, similarity, score, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS item_id,
         round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity,
         round((greatest(-1, least(1, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]))) + 1) / 2, 6) AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS INTEGER) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0)
WHERE rank <= 10
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every id divisible by 50, by exact inner product."""
    items = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    found = recall.vector_topk(asked, items, 10)
    return found.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), V.score_of(F.col("similarity")).alias("score"), "rank")


@query("""
SELECT vec_id, len(embedding)::INTEGER AS dimension, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
       abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.0002 AND len(embedding) = 64 AS valid
FROM embeddings
""")
def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.size(v).alias("dimension"), F.round(V.norm(v), 6).alias("norm"), V.is_valid(v, 64).alias("valid"))


@query("""
SELECT vec_id, round((greatest(-1, least(1, embedding[1]::DOUBLE * 3)) + 1) / 2, 6) AS score FROM embeddings
""")
def vector_score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", V.score_of(F.col("embedding")[0].cast("double") * 3).alias("score"))


@query("""
SELECT q.p_partkey AS query_key, c.p_partkey AS material_code
FROM part q JOIN part c ON q.p_partkey % 50 = 0 AND q.p_brand = c.p_brand
 AND (q.p_type = 'PROMO' OR c.p_type = q.p_type OR c.p_type = 'PROMO')
""")
def structured_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the same brand whose type agrees, the type PROMO standing for an empty field."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select(
        F.col("p_partkey").alias("material_code"), F.col("p_brand").alias("category"), F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("kind")
    )
    asked = part.filter("material_code % 50 = 0").withColumnRenamed("material_code", "query_key")
    return recall.structured_recall(asked, part, "query_key", "category", ("kind",), "material_code")


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def recall_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return recall.indexed(table(spark, sf_dir, "part", "p_partkey", "p_brand"), wanted, "p_partkey")


@query("""
SELECT query_key, material_code, min(source)::INTEGER AS first_source, count(DISTINCT source) AS sources FROM (
  SELECT l_orderkey AS query_key, l_partkey AS material_code, 0 AS source FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, l_partkey, 1 FROM lineitem WHERE l_quantity >= 25)
GROUP BY 1, 2
""")
def recall_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_quantity").withColumnsRenamed({"l_orderkey": "query_key", "l_partkey": "material_code"})
    return recall.union_recall(lines.filter("l_returnflag = 'R'"), lines.filter("l_quantity >= 25"), "query_key", "material_code")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 450000)")
def recall_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").filter("o_totalprice >= 450000").select(F.col("o_custkey").alias("c_custkey"))
    return states.missing(table(spark, sf_dir, "customer", "c_custkey", "c_name"), placed, ["c_custkey"])


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'paired' END AS pairing
FROM documents d FULL OUTER JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
""")
def pair_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.pairing(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id", "quality").filter("quality = 1"), ["doc_id"])


@query("""
SELECT 'only_first' AS side, user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value < 15 EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE value >= 15)
UNION ALL
SELECT 'only_second', user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 15 EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE value < 15)
""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both differences of two sets."""
    events = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    return documents.set_differences(*(events.filter(c).select("user_id", "event_type") for c in ("value < 15", "value >= 15")))


# ---- scores, ranks, decisions

@query("""
SELECT p_partkey, structured_score, comparable_fields, round(0.75::DOUBLE * structured_score + 0.25::DOUBLE * vector_score, 4) AS match_score FROM (
  SELECT p_partkey, round((p_partkey % 101) / 100.0, 6)::DOUBLE AS vector_score,
    (CASE WHEN p_size >= 5 THEN 1 ELSE 0 END + 1 + CASE WHEN p_type <> 'PROMO' THEN 1 ELSE 0 END)::INTEGER AS comparable_fields,
    round((CASE WHEN p_size < 5 THEN 0 WHEN p_size <= 25 THEN 0.25 ELSE 0.15 END + CASE WHEN p_brand < 'Brand#2' THEN 0.171 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 0 ELSE 0.17 * 0.95 END)
      / (CASE WHEN p_size < 5 THEN 0 ELSE 0.25 END + 0.18 + CASE WHEN p_type = 'PROMO' THEN 0 ELSE 0.17 END)::DOUBLE, 6) AS structured_score
  FROM part)
""")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean over the comparable fields of a part, blended with a second score."""
    spec = F.when(F.col("p_size") < 5, None).when(F.col("p_size") <= 25, 1.0).otherwise(0.6)
    composition = F.when(F.col("p_brand") < "Brand#2", 0.95).otherwise(0.0)
    fabric = F.when(F.col("p_type") != "PROMO", 0.95)
    score, count = summary.weighted_mean([(spec, 0.25), (composition, 0.18), (fabric, 0.17)])
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand", "p_type").select("p_partkey", score.alias("structured_score"), count.alias("comparable_fields"))
    blend = 0.75 * F.col("structured_score") + 0.25 * F.round(F.col("p_partkey") % 101 / 100.0, 6)
    return rows.withColumn("match_score", F.round(blend, 4))


RANKED = "(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS ordinal FROM part)"


@query(f"""
SELECT p_brand, p_partkey, p_size, ordinal::INTEGER AS ordinal, (min(ordinal) OVER (PARTITION BY p_brand, island))::INTEGER AS rank FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY ordinal) AS island FROM (
    SELECT *, CASE WHEN abs(lag(p_size) OVER (PARTITION BY p_brand ORDER BY ordinal) - p_size) <= 1 THEN 0 ELSE 1 END AS fresh FROM {RANKED}))
""")
def island_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes within one of the row before tie with it, so ties chain."""
    rows = ranking.numbered(table(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", ["p_partkey"])
    return ranking.island_rank(rows, ["p_brand"], "p_size", tie=1.0)


@query(f"""
SELECT p_brand, max(CASE WHEN ordinal = 1 THEN p_retailprice END) AS top1_score,
       round(max(CASE WHEN ordinal = 1 THEN p_retailprice END) - max(CASE WHEN ordinal = 2 THEN p_retailprice END), 6) AS top1_margin, count(*) AS candidates
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS ordinal FROM part) GROUP BY p_brand
""")
def top1_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.numbered(table(spark, sf_dir, "part", "p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", ["p_partkey"])
    return ranking.top_margin(rows, ["p_brand"], "p_retailprice")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS ordinal FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS candidates, max(CASE WHEN ordinal = 1 THEN l_linenumber END) AS comparable,
  round(max(CASE WHEN ordinal = 1 THEN l_discount END) - max(CASE WHEN ordinal = 2 THEN l_discount END), 6) AS margin,
  coalesce(max(CASE WHEN ordinal = 1 THEN l_returnflag END) = 'R', FALSE) AS dup FROM r GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN comparable < 3 THEN 'insufficient_evidence' WHEN dup THEN 'ambiguous_tie' WHEN margin IS NOT NULL AND abs(margin) <= 0.000001 THEN 'ambiguous_tie'
  WHEN candidates = 1 OR margin > 0.000001 THEN 'unique_best_candidate' ELSE 'ranked_candidates' END AS decision FROM g
""")
def decision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, their lines as candidates, the discount as score."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    rows = ranking.numbered(lines, ["l_orderkey"], "l_discount", ["l_linenumber"])
    first = F.col("ordinal") == 1
    margin = F.round(F.max(F.when(first, F.col("l_discount"))) - F.max(F.when(F.col("ordinal") == 2, F.col("l_discount"))), 6)
    top = rows.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(first, F.col("l_linenumber"))).alias("comparable"), margin.alias("margin"), F.coalesce(F.max(F.when(first, F.col("l_returnflag"))) == "R", F.lit(False)).alias("dup")
    )
    return top.select("l_orderkey", ranking.decision(F.col("n"), F.col("comparable"), F.col("dup"), F.col("margin")).alias("decision"))


@query("SELECT lang, sha256(text) AS text_sha256, count(*) AS duplicate_group_size FROM documents GROUP BY lang, text HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "lang", "text").select("lang", F.sha2("text", 256).alias("text_sha256"))
    return ranking.duplicate_groups(docs, ["lang"], "text_sha256")


@query("""
SELECT p_brand, p_name, count(*) AS duplicate_group_size,
  array_to_string(list_filter([CASE WHEN count(DISTINCT p_type) = 1 THEN 'p_type' END, CASE WHEN count(DISTINCT p_size) = 1 THEN 'p_size' END], lambda x: x IS NOT NULL), ',') AS identical_fields,
  array_to_string(list_filter([CASE WHEN count(DISTINCT p_type) <> 1 THEN 'p_type' END, CASE WHEN count(DISTINCT p_size) <> 1 THEN 'p_size' END], lambda x: x IS NOT NULL), ',') AS differing_fields
FROM part GROUP BY p_brand, p_name HAVING count(*) > 1
""")
def duplicate_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ranking.duplicate_groups(table(spark, sf_dir, "part", "p_brand", "p_name", "p_type", "p_size"), ["p_brand"], "p_name", fields=("p_type", "p_size"))
    return groups.withColumns({c: F.array_join(c, ",") for c in ("identical_fields", "differing_fields")})


# ---- aggregates

@query("""
SELECT l_returnflag, count(*) AS count, round(min(l_extendedprice), 6) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(max(l_extendedprice), 6) AS max FROM lineitem GROUP BY l_returnflag
""")
def five_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.five_numbers(table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'signup') AS signup,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id
""")
def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status_matrix(table(spark, sf_dir, "events", "user_id", "event_type"), "user_id", "event_type", ("view", "click", "signup", "purchase", "error"))


@query("""
WITH x AS (SELECT user_id, unnest([CASE WHEN value < 5 THEN 'low' END, CASE WHEN event_type = 'error' THEN 'error' END]) AS field FROM events)
SELECT field, user_id, count(*) AS n FROM x WHERE field IS NOT NULL GROUP BY field, user_id
UNION ALL SELECT field, NULL, count(*) FROM x WHERE field IS NOT NULL GROUP BY field
""")
def hard_conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflicts = F.array_compact(F.array(F.when(F.col("value") < 5, "low"), F.when(F.col("event_type") == "error", "error")))
    return summary.conflict_counts(table(spark, sf_dir, "events", "user_id", "value", "event_type").withColumn("conflicts", conflicts), "user_id", "conflicts")


@query("""
SELECT column_name, count(*) AS row_count, count(*) FILTER (WHERE v = '') AS empty_count, count(DISTINCT v) AS distinct_count,
       count(*) FILTER (WHERE v <> '') - count(DISTINCT CASE WHEN v <> '' THEN v END) AS repeated, column_name = 'p_name' AS is_key
FROM (SELECT 'p_name' AS column_name, coalesce(p_name, '') AS v FROM part UNION ALL SELECT 'p_brand', coalesce(p_brand, '') FROM part UNION ALL SELECT 'p_type', CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END FROM part)
GROUP BY column_name
""")
def column_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_name", "p_brand", "p_type").withColumn("p_type", F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")))
    return summary.column_audit(part, ["p_name", "p_brand", "p_type"], key="p_name")


@query("SELECT p_name, count(*) AS n FROM part WHERE p_name <> '' GROUP BY p_name ORDER BY n DESC, p_name LIMIT 20")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.most_common(table(spark, sf_dir, "part", "p_name"), "p_name", 20)


@query("""
WITH r AS (SELECT toxic, CASE WHEN quality = 1 THEN doc_id % 14 + 1 END AS rank FROM labels)
SELECT toxic, count(*) AS reviewed, count(*) FILTER (WHERE rank <= 1) AS top1_hits, count(*) FILTER (WHERE rank <= 3) AS top3_hits, count(*) FILTER (WHERE rank <= 10) AS top10_hits,
  round(count(*) FILTER (WHERE rank <= 1) / count(*)::DOUBLE, 6) AS top1_rate, round(count(*) FILTER (WHERE rank <= 3) / count(*)::DOUBLE, 6) AS top3_rate,
  round(count(*) FILTER (WHERE rank <= 10) / count(*)::DOUBLE, 6) AS top10_rate, count(*) FILTER (WHERE rank IS NULL OR rank > 10) AS outside FROM r GROUP BY toxic
""")
def topk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("rank", F.when(F.col("quality") == 1, F.col("doc_id") % 14 + 1))
    return summary.hit_rates(labels, ["toxic"], "rank", (1, 3, 10))


# ---- order-dependent row logic

@query("""
WITH p AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS priority FROM conversations),
m AS (SELECT conv_id, min(priority) AS priority FROM p GROUP BY conv_id)
SELECT p.conv_id, m.priority::INTEGER AS priority, CASE WHEN count(DISTINCT lower(text)) = 1 THEN sha256(min(text)) ELSE sha256('') END AS value_sha256,
       CASE WHEN count(DISTINCT lower(text)) = 1 THEN 'normalized' ELSE 'ambiguous' END AS status
FROM p JOIN m ON p.conv_id = m.conv_id AND p.priority = m.priority GROUP BY p.conv_id, m.priority
""")
def priority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "role", "text").withColumn("priority", F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2))
    found = ranking.resolve_by_priority(turns, ["conv_id"], "priority", "text")
    return found.select("conv_id", "priority", F.sha2("value", 256).alias("value_sha256"), "status")


@query("""
SELECT conv_id, (min(turn) FILTER (WHERE role = 'assistant'))::BIGINT AS first_turn, sha256(coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '')) AS text_sha256 FROM conversations GROUP BY conv_id
""")
def first_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one row whose headers are the roles: the first column that the header word names."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    place = items.pick_column(F.transform("t", lambda t: t["text"]), F.transform("t", lambda t: t["role"]), ("assistant",), None)
    found = rows.withColumn("found", F.get("t", place))
    return found.select("conv_id", F.col("found.turn").alias("first_turn"), F.sha2(F.coalesce("found.text", F.lit("")), 256).alias("text_sha256"))


@query("""
SELECT conv_id, turn, sha256(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS carried_sha256 FROM conversations
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    carried = sheets.carried(F.when(F.col("role") == "user", F.col("text")), ["conv_id"], "turn")
    return turns.select("conv_id", "turn", F.sha2(F.coalesce(carried, F.lit("")), 256).alias("carried_sha256"))


@query("""
SELECT l_orderkey, min(l_linenumber)::INTEGER AS first_line, max(l_linenumber)::INTEGER AS last_line, count(*) AS lines FROM (
  SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
GROUP BY l_orderkey, island
""")
def consecutive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sheets.with_islands(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber", "island")
    return lines.groupBy("l_orderkey", "island").agg(F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.count(F.lit(1)).alias("lines")).drop("island")


@query("""
SELECT a.conv_id, a.turn, b.turn AS reply_turn, sha256(b.text) AS reply_sha256
FROM (SELECT * FROM conversations WHERE role = 'user') a
JOIN (SELECT conv_id, turn, role, text FROM conversations) b ON a.conv_id = b.conv_id AND b.role = 'assistant' AND b.turn BETWEEN a.turn + 1 AND a.turn + 4
QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn - a.turn) = 1
""")
def adjacent_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest value up to four places behind a label."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    values = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("reply_turn"), F.sha2("text", 256).alias("reply_sha256"))
    near = metadata.beside(turns.filter("role = 'user'").select("conv_id", "turn"), values, ["conv_id"], "turn", "reply_turn", 4)
    return near.groupBy("conv_id", "turn").agg(F.min(F.struct("reply_turn", "reply_sha256")).alias("best")).select("conv_id", "turn", "best.*")


# ---- scalar functions

@query("""
SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'email') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END)::INTEGER AS score FROM documents
""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keywords a text has."""
    score = sheets.header_score(F.array("text"), ("the", "license", "email", "der"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", score.alias("score"))


@query(r"""
SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '\n', ' ', 'g'), '\s{2,}', ' ', 'g'))) AS clean_length, sha256(trim(regexp_replace(regexp_replace(text, '\n', ' ', 'g'), '\s{2,}', ' ', 'g'))) AS clean_sha256 FROM documents
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = X.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.length(cleaned).cast("bigint").alias("clean_length"), F.sha2(cleaned, 256).alias("clean_sha256"))


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS folded_sha256 FROM documents")
def casefold_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(X.audit_text(F.col("text")), 256).alias("folded_sha256"))


@query("""
SELECT p_partkey, (p_size * 2)::VARCHAR || '*' || (CASE WHEN (p_size * 10 / 10.0) = floor(p_size * 10 / 10.0) THEN p_size::VARCHAR END) || 'cm' AS size FROM part
""")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled size in millimetres, width before length, becomes length*width in centimetres."""
    from weftspark.functions.fields import order_size

    written = F.concat(F.lit("W: "), (F.col("p_size") * 10).cast("string"), F.lit("mm x L: "), (F.col("p_size") * 20).cast("string"), F.lit("mm"))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", order_size(written, F.lit("")).alias("size"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\bwhite\\b') THEN '漂白色' WHEN regexp_matches(p_name, '\\bgr[ae]y\\b') THEN '灰色' WHEN regexp_matches(p_name, '\\bblue\\b') THEN '蓝色' ELSE p_name END AS color FROM part
""".replace("\\\\", "\\"))
def color_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.functions.fields import master_color

    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", master_color(F.col("p_name")).alias("color"))


@query("SELECT o_orderkey, (2000 + o_orderkey % 30)::VARCHAR || strftime(o_orderdate, '-%m-%d') AS ship_date FROM orders")
def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date written month first, among other words, as YYYY-MM-DD."""
    written = F.concat(F.lit("ETD "), F.date_format(F.col("o_orderdate").cast("timestamp"), "M/d/"), (2000 + F.col("o_orderkey") % 30).cast("string"), F.lit(" latest"))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", X.parse_date(written).alias("ship_date"))


@query(r"""
SELECT doc_id, CASE WHEN strpos(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'the') > 0 THEN strpos(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'the') - 1 END AS start FROM documents
""")
def quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = X.quote_position(F.lit(" THE "), F.array("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", place["start"].cast("bigint").alias("start"))


# ---- run state

ALLOWED = {"view": ("view", "click", "error"), "click": ("purchase", "view", "error"), "signup": ("view",), "purchase": ("view",), "error": ()}


@query("""
SELECT event_id, user_id, event_type, previous_state,
  CASE WHEN previous_state IS NULL THEN event_type IN ('view', 'signup') ELSE previous_state || '>' || event_type IN ('view>view', 'view>click', 'view>error', 'click>purchase', 'click>view', 'click>error', 'signup>view', 'purchase>view') END AS legal
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events)
""")
def transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return states.check_transitions(events, ["user_id"], ["ts", "event_id"], "event_type", ALLOWED, ("view", "signup")).drop("ts")


@query("""
SELECT conv_id, count(*) AS revisions, bool_and(turn = rn - 1 AND parent IS NOT DISTINCT FROM before) AS contiguous FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
         CASE WHEN turn > 0 THEN lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent FROM conversations)
GROUP BY conv_id
""")
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("revision", F.sha2("text", 256)).drop("text")
    before = F.lag("revision").over(Window.partitionBy("conv_id").orderBy("turn"))
    return states.check_lineage(turns.withColumn("parent", F.when(F.col("turn") > 0, before)), ["conv_id"], "turn", "revision", "parent")


@query("SELECT user_id, count(*) AS revisions, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.latest(table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("""
SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, count(*) AS requests, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id
""")
def idempotent_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.claims(table(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id"), "user_id", ["event_type"], ["ts", "event_id"])


@query("""
SELECT event_id, user_id, gap_us FROM (SELECT event_id, user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap_us FROM events) WHERE gap_us > 1800000000
""")
def stale_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events followed by more than half an hour of silence."""
    return states.gaps_over(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"], 1800).select("event_id", "user_id", "gap_us")


@query("""
SELECT l_orderkey, l_linenumber, 'quantity_too_large' AS rule FROM lineitem WHERE l_quantity > 49
UNION ALL SELECT l_orderkey, l_linenumber, 'unknown_order' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT l_orderkey, l_linenumber, 'no_discount_on_return' FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0
""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the columns of a row, and one over another table."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    key = ["l_orderkey", "l_linenumber"]
    rules = {"quantity_too_large": F.col("l_quantity") > 49, "no_discount_on_return": (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)}
    unknown = states.missing(lines, table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    return contracts.broken(lines, key, rules).unionByName(unknown.select(*key, F.lit("unknown_order").alias("rule")))


@query("SELECT l_orderkey FROM (SELECT unnest(range(min(l_orderkey), max(l_orderkey) + 1)) AS l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def numbered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.number_gaps(table(spark, sf_dir, "lineitem", "l_orderkey"), "l_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def resume_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do."""
    done = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return states.missing(table(spark, sf_dir, "part", "p_partkey"), done, ["p_partkey"])
