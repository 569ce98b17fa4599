"""Operators of the order domain on the driver's tables, whose columns stand in for cells, candidates and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import fields as N
from weftspark.operators import dictionary, metadata, resolution, review, scoring, sheets
from weftspark.operators.master import labelled_text
from weftspark.plans.queries import query
from weftspark.sources.tables import table
from weftspark.streaming import runs


@query("""
WITH s AS (SELECT n_regionkey, n_nationkey, lower(CASE WHEN n_nationkey % 7 = 0 THEN 'PI' WHEN n_nationkey % 5 = 0 THEN 'my P-I ' || n_name ELSE n_name END) AS sheet FROM nation)
SELECT n_regionkey::VARCHAR AS file, arg_min(n_nationkey, (CASE WHEN sheet = 'pi-update' THEN 0 WHEN sheet = 'pi' THEN 1 WHEN contains(regexp_replace(sheet, '[^a-z0-9]', '', 'g'), 'pi') THEN 2 ELSE 3 END, n_nationkey)) AS sheet_idx
FROM s GROUP BY n_regionkey
""")
def choose_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sheets of their region's workbook."""
    key = F.col("n_nationkey")
    name = F.when(key % 7 == 0, "PI").when(key % 5 == 0, F.concat(F.lit("my P-I "), "n_name")).otherwise(F.col("n_name"))
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("file"), key.alias("sheet_idx"), name.alias("sheet"))
    return sheets.choose_sheet(cells).select("file", "sheet_idx")


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS text FROM conversations)
SELECT c.conv_id::VARCHAR AS file, c.turn::INTEGER AS row, CASE WHEN c.text = '' AND f.text IS NOT NULL THEN f.text ELSE c.text END AS text
FROM c LEFT JOIN (SELECT conv_id, text FROM c WHERE turn = 0) f ON c.conv_id = f.conv_id
""")
def fill_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as one merged column whose first cell has the value."""
    turn = F.col("turn").cast("int")
    cells = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").select(
        F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("sheet_idx"), turn.alias("row"), F.lit(1).alias("col"), F.when(turn % 2 == 0, F.col("role")).otherwise("").alias("text"), F.lit(0).alias("anchor_row"), F.lit(1).alias("anchor_col")
    )
    return sheets.fill_merged(cells).select("file", "row", "text")


@query("""
WITH r AS (SELECT conv_id, unnest([2, 0, 0, 1, 99]) AS turn, unnest([0, 1, 2, 3, 4]) AS pos FROM (SELECT DISTINCT conv_id FROM conversations)),
f AS (SELECT r.conv_id, c.role, min(r.pos) AS pos FROM r JOIN conversations c ON r.conv_id = c.conv_id AND r.turn = c.turn GROUP BY r.conv_id, c.role)
SELECT conv_id, string_agg(role, ' | ' ORDER BY pos) AS source_text FROM f GROUP BY conv_id
""")
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles at a list of turns, each once, in the list's order."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    cells = turns.select(F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("sheet_idx"), F.concat(F.lit("A"), "turn").alias("ref"), F.col("role").alias("text"))
    refs = turns.select("conv_id").distinct().select("conv_id", F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("sheet_idx"), F.array(*[F.lit(f"A{n}") for n in (2, 0, 0, 1, 99)]).alias("refs"))
    return dictionary.evidence_text(refs, cells, ["conv_id"])


@query("""
SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'dictionary_no_match' WHEN p_size > 40 AND p_type <> 'SMALL' THEN 'ambiguous' WHEN p_size > 40 THEN 'exact_match' WHEN p_size % 3 = 0 THEN 'exact_match' WHEN p_size % 3 = 1 THEN 'equivalent_match' ELSE 'conflict' END AS status FROM part
""")
def single_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    other = F.when(size % 3 == 0, kind).when(size % 3 == 1, F.concat(F.lower(kind), F.lit("  "))).otherwise("else")
    candidates = F.when(size <= 5, F.array(F.lit(" "))).when(size > 40, F.array(kind, F.lit("SMALL"), kind)).otherwise(F.array(other))
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").select("p_partkey", dictionary.single_candidate(candidates, kind).alias("status"))


@query("""
WITH c AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'dictionary_no_match' WHEN 2 THEN 'exact_match' ELSE 'partial_match' END AS status,
  CASE WHEN p_brand < 'Brand#2' THEN 'defaulted' WHEN p_type = 'PROMO' THEN 'unrecognized' ELSE 'normalized' END AS vs, p_size % 5 = 0 AS nosource, p_type = 'LARGE' AS incomplete FROM part)
SELECT p_partkey, CASE WHEN status = 'conflict' THEN 'manual_review' WHEN status = 'dictionary_no_match' AND vs = 'defaulted' THEN 'keep_default' WHEN status = 'dictionary_no_match' THEN 'keep_python'
  WHEN vs = 'defaulted' THEN CASE WHEN nosource THEN 'keep_default' ELSE 'propose_replace_default' END WHEN vs = 'unrecognized' THEN CASE WHEN nosource THEN 'keep_python' ELSE 'propose_fill' END
  WHEN status = 'exact_match' OR nosource OR incomplete THEN 'keep_python' ELSE 'propose_enrich' END AS action FROM c
""")
def integration_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, none = F.col("p_size") % 4, F.array().cast("array<string>")
    status = F.when(size == 0, "conflict").when(size == 1, "dictionary_no_match").when(size == 2, "exact_match").otherwise("partial_match")
    value_status = F.when(F.col("p_brand") < "Brand#2", "defaulted").when(F.col("p_type") == "PROMO", "unrecognized").otherwise("normalized")
    source = F.when(F.col("p_size") % 5 == 0, " ").otherwise("text")
    missing = F.when(F.col("p_type") == "LARGE", F.array(F.lit("m"))).otherwise(none)
    action = dictionary.integration_action(status, F.col("p_name"), value_status, F.array(F.lit("c"), F.lit("c")), source, F.array(F.lit("B2")), F.array(F.lit("m")), missing, none)
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand", "p_type", "p_name").select("p_partkey", action["action"].alias("action"))


@query("""
WITH s AS (SELECT user_id::VARCHAR AS field, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'exact_match' WHEN event_type = 'purchase' THEN 'equivalent_match' WHEN value < 8 THEN 'conflict' ELSE 'partial_match' END AS status FROM events),
c AS (SELECT field, count(*) AS total, count(*) FILTER (WHERE status IN ('exact_match', 'equivalent_match')) AS verified, count(*) FILTER (WHERE status = 'conflict') AS manual, count(*) FILTER (WHERE status = 'partial_match') AS partial FROM s GROUP BY field)
SELECT field, total, round(verified / total::DOUBLE, 6) AS verified_share, CASE WHEN verified / total::DOUBLE < 0.6 THEN 'not_ready' WHEN verified / total::DOUBLE < 0.8 THEN 'high_risk' WHEN verified / total::DOUBLE >= 0.9 AND manual = 0 AND partial = 0 THEN 'low_risk' ELSE 'medium_risk' END AS risk FROM c
""")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click", "signup"), "exact_match").when(kind == "purchase", "equivalent_match").when(F.col("value") < 8, "conflict").otherwise("partial_match")
    events = table(spark, sf_dir, "events", "user_id", "event_type", "value").select(F.col("user_id").cast("string").alias("field"), status.alias("status"))
    return dictionary.risk_levels(events).select("field", "total", "verified_share", "risk")


@query("""
SELECT c.c_custkey, n.n_nationkey AS source_row FROM customer c JOIN nation n
ON (c.c_nationkey % 6 = 5 OR c.c_nationkey % 6 = n.n_regionkey) AND (c.c_mktsegment <> 'BUILDING' OR n.n_nationkey % 2 = 1)
""")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a dictionary of 25 rows: category by region, colour by parity; customers leave either open."""
    region, odd = F.col("c_nationkey") % 6, F.col("n_nationkey") % 2 == 1
    pairs = lambda a, b: F.create_map(F.lit("category"), a, F.lit("color"), b)
    asked = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select("c_custkey", pairs(F.when(region == 5, "").otherwise(region.cast("string")), F.when(F.col("c_mktsegment") == "BUILDING", "odd").otherwise("")).alias("components"))
    book = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_row"), pairs(F.col("n_regionkey").cast("string"), F.when(odd, "odd").otherwise("even")).alias("components"))
    return dictionary.match_fabrics(asked, book, "c_custkey")


@query("SELECT p_partkey, rule FROM part JOIN (VALUES ('RING', 1), ('widget', 2), ('Red', 3)) r(keyword, rule) ON contains(lower(p_name), lower(keyword))")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("RING", 1), ("widget", 2), ("Red", 3)], "keyword string, rule int")
    return dictionary.match_keywords(table(spark, sf_dir, "part", "p_partkey", "p_name"), rules, "p_name", "keyword").select("p_partkey", "rule")


@query("""
WITH r AS (SELECT doc_id, 'M' || (doc_id % 4) AS rec, 'M' || (doc_id % 3) AS cor, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'ok' WHEN 2 THEN 'other' WHEN 3 THEN 'out' WHEN 4 THEN 'none' ELSE 'fields' END AS c FROM labels),
k AS (SELECT *, CASE WHEN c IN ('ok', 'other', 'out') THEN doc_id % 3 * 4 + 1 END AS rank FROM r)
SELECT count(*) AS total_rows, count(*) FILTER (WHERE c <> '') AS reviewed_rows, count(*) FILTER (WHERE rank IS NOT NULL) AS positive_truth_rows, count(*) FILTER (WHERE c = 'none') AS no_material_truth_rows, count(*) FILTER (WHERE c = 'fields') AS excluded_rows,
  count(*) FILTER (WHERE rank <= 1) AS top1_hits, count(*) FILTER (WHERE rank <= 3) AS top3_hits, count(*) FILTER (WHERE rank <= 10) AS top10_hits,
  round(count(*) FILTER (WHERE rank <= 1) / count(rank)::DOUBLE, 6) AS top1_rate, round(count(*) FILTER (WHERE rank <= 3) / count(rank)::DOUBLE, 6) AS top3_rate, round(count(*) FILTER (WHERE rank <= 10) / count(rank)::DOUBLE, 6) AS top10_rate,
  count(rank) - count(*) FILTER (WHERE rank <= 10) AS outside_top10, count(*) FILTER (WHERE c = 'none' AND doc_id % 12 = 4) AS no_recommendation_hits, count(*) FILTER (WHERE c = 'none' AND doc_id % 12 <> 4) AS false_recommendations,
  round(count(*) FILTER (WHERE c = 'none' AND doc_id % 12 = 4) / count(*) FILTER (WHERE c = 'none')::DOUBLE, 6) AS no_recommendation_rate FROM k
""")
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as reviewed orders; code Mk stands at rank 4k + 1 among an order's candidates."""
    doc = F.col("doc_id")
    conclusion = F.when(doc % 6 == 0, "").when(doc % 6 == 1, review.RECOMMENDED).when(doc % 6 == 2, review.OTHER).when(doc % 6 == 3, review.OUTSIDE).when(doc % 6 == 4, review.NO_MATERIAL).otherwise(review.WRONG_FIELDS)
    labels = table(spark, sf_dir, "labels", "doc_id")
    code = lambda n: F.concat(F.lit("M"), (doc % n).cast("string"))
    sheet = labels.select(doc.cast("string").alias("audit_id"), F.when(doc % 12 == 4, "").otherwise(code(4)).alias("recommended"), code(3).alias("correct"), conclusion.alias("conclusion"))
    candidates = labels.select(doc.cast("string").alias("audit_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("audit_id", F.concat(F.lit("M"), "k").alias("material_code"), (F.col("k") * 4 + 1).alias("rank"))
    out = review.metrics(sheet, candidates)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_rate")})


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN 'ai_selected' WHEN toxic = 1 OR lang = 'en' THEN 'python_fallback' ELSE 'missing' END AS status,
  CASE WHEN quality = 1 AND lang = 'en' AND toxic = 0 THEN 'agree' WHEN quality = 1 AND lang = 'en' THEN 'equivalent_after_normalization' WHEN quality = 1 AND toxic = 1 THEN 'different' WHEN quality = 1 THEN 'ai_only' WHEN toxic = 1 OR lang = 'en' THEN 'python_fill' ELSE 'both_missing' END AS comparison
FROM documents JOIN labels USING (doc_id)
""")
def field_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a model's candidates for one field, languages as the rule's values."""
    rows = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    field = F.lit("颜色").alias("field")
    value = F.when(F.col("toxic") == 1, "en ").otherwise("en")
    candidates = rows.select(F.col("doc_id").alias("record_id"), field, value.alias("value"), F.lit("direct").alias("interpretation"), F.lit("").alias("quote"), F.when(F.col("quality") == 0, "direct_candidate_untraceable").alias("issue"))
    rules = rows.select(F.col("doc_id").alias("record_id"), field, F.col("lang").alias("value"), ((F.col("toxic") == 1) | (F.col("lang") == "en")).alias("has_evidence"))
    return resolution.decide(candidates, rules).select(F.col("record_id").alias("doc_id"), "status", "comparison")


@query(r"""
WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM conversations),
q AS (SELECT conv_id, conv_id % 4 AS ref, lower(trim(regexp_replace(substr(any_value(text) FILTER (WHERE turn = 0), 1, 15), '\s+', ' ', 'g'))) AS quote FROM conversations GROUP BY conv_id)
SELECT q.conv_id, CASE WHEN t.text IS NULL THEN 'evidence_id_missing' WHEN ref % 2 = 1 THEN 'evidence_not_in_target' END AS violation,
  CASE WHEN q.quote = '' OR q.quote IS NULL OR t.text IS NULL OR strpos(t.text, q.quote) = 0 THEN 'direct_candidate_untraceable' END AS issue
FROM q LEFT JOIN t ON q.conv_id = t.conv_id AND q.ref = t.turn
""")
def evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of a conversation's first turn, said to be found in turn conv_id mod 4; even turns may be cited."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    name = lambda t: F.concat_ws("-", F.col("conv_id"), t)
    catalog = turns.select(name(F.col("turn")).alias("evidence_id"), F.col("conv_id").cast("string").alias("scope_id"), "text")
    convs = turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.left("text", F.lit(15)))).alias("value"))
    targets = convs.select(F.col("conv_id").alias("record_id"), F.col("conv_id").cast("string").alias("scope_id"), F.array(name(F.lit(0)), name(F.lit(2))).alias("evidence_ids"))
    candidates = convs.select(F.col("conv_id").alias("record_id"), F.lit("f").alias("field"), "value", F.lit("direct").alias("interpretation"), F.lit("").alias("quote"), F.array(name(F.col("conv_id") % 4)).alias("references"))
    return resolution.bind(candidates, catalog, targets).select(F.col("record_id").alias("conv_id"), "violation", "issue")


@query("""
WITH q AS (SELECT a.p_partkey, a.p_brand = b.p_brand AS cat, a.p_type = b.p_type AS lab, a.p_size = b.p_size AS siz FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, CASE WHEN cat THEN '' ELSE 'product_category' END AS conflicts, 2 AS comparable_fields, round((CASE WHEN lab THEN 0.04 ELSE 0 END + CASE WHEN siz THEN 0.03 ELSE 0 END)::DOUBLE / 0.07::DOUBLE, 6) AS structured_score FROM q
""")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part compared with the next one in three fields; six fields are empty and leave the weights."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    empty = {f: F.lit("") for f in ("spec", "color", "fabric", "composition", "density", "style", "fabric_category")}
    rows = part.select("p_partkey", F.col("p_brand").alias("product_category"), F.col("p_type").alias("label_method"), F.col("p_size").cast("string").alias("size_type")).withColumns(empty)
    own = scoring.prepared(rows, "q_").drop(*scoring.COMPARED, "fabric_category")
    other = scoring.prepared(rows.withColumn("p_partkey", F.col("p_partkey") - 1), "m_").drop(*scoring.COMPARED, "fabric_category")
    scored = scoring.evaluated(own.join(other, "p_partkey").withColumn("similarity", F.lit(0.0)), "q_", "m_", "similarity")
    return scored.select("p_partkey", F.array_join("conflicts", ",").alias("conflicts"), "comparable_fields", "structured_score")


@query(r"""
WITH u AS (SELECT doc_id, text, upper(text) AS t FROM documents),
f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])USD($|[^A-Z0-9])') OR contains(t, 'US$') THEN '美元' END, CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])CNY($|[^A-Z0-9])') OR contains(t, 'CN¥') OR contains(t, 'CN￥') THEN '人民币' END,
   CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])RMB($|[^A-Z0-9])') THEN '人民币' END, CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])EUR($|[^A-Z0-9])') THEN '欧元' END, CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])GBP($|[^A-Z0-9])') THEN '英镑' END,
   CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])JPY($|[^A-Z0-9])') THEN '日元' END, CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])AED($|[^A-Z0-9])') THEN '阿联酋迪拉姆' END, CASE WHEN regexp_matches(t, '(^|[^A-Z0-9])SAR($|[^A-Z0-9])') THEN '沙特里亚尔' END], lambda x: x IS NOT NULL) AS explicit,
  list_filter([CASE WHEN contains(text, '$') THEN '美元' END, CASE WHEN contains(text, '€') THEN '欧元' END, CASE WHEN contains(text, '£') THEN '英镑' END, CASE WHEN contains(text, '¥') OR contains(text, '￥') THEN '人民币' END, CASE WHEN contains(text, '円') THEN '日元' END], lambda x: x IS NOT NULL) AS symbol FROM u)
SELECT doc_id::VARCHAR AS file, CASE WHEN len(explicit) = 1 THEN explicit[1] WHEN len(explicit) = 0 AND len(symbol) = 1 THEN symbol[1] ELSE '' END AS currency,
  CASE WHEN len(explicit) = 1 OR len(explicit) = 0 AND len(symbol) = 1 THEN 'normalized' WHEN len(explicit) > 1 OR len(symbol) > 1 THEN 'ambiguous' ELSE 'source_not_provided' END AS currency_status FROM f
""")
def currency_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sheet of one cell."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("file"), F.lit(0).alias("sheet_idx"), F.lit("s").alias("sheet"), F.lit(1).alias("row"), F.array(F.coalesce("text", F.lit(""))).alias("cells"), F.array(F.lit("")).alias("formats"))
    return metadata.currency(rows).drop("sheet_idx")


@query("""
SELECT p_partkey, 'T' || (p_size * 10)::VARCHAR AS density, 'C' || p_size::VARCHAR || '/T' || (100 - p_size)::VARCHAR AS composition, (p_size * 10)::VARCHAR || '*' || (p_size * 20)::VARCHAR || 'cm+5cm' AS spec,
  p_size::VARCHAR || 'S*40S' AS yarn, CASE WHEN p_type = 'PROMO' THEN '被套' ELSE '' END AS category FROM part
""")
def master_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised master fields of values written in odd ways."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").select(
        "p_partkey",
        N.master_density(F.concat(F.lit("tc "), size * 10)).alias("density"),
        N.master_composition(F.concat(F.lit("t "), 100 - size, F.lit(" / c"), size)).alias("composition"),
        N.master_spec(F.concat(size * 100, F.lit(" mm × "), size * 200, F.lit("mm + 50mm"))).alias("spec"),
        N.master_yarn(F.concat(size, F.lit("s x 40s"))).alias("yarn"),
        N.master_category(F.when(F.col("p_type") == "PROMO", "King  DUVET cover").otherwise(F.col("p_type"))).alias("category"),
    )


@query("""
SELECT p_partkey, 'C' || p_size::VARCHAR || '/T' || (100 - p_size)::VARCHAR AS composition, '斜纹/T' || (200 + p_size)::VARCHAR || '/C' || p_size::VARCHAR || '/T' || (100 - p_size)::VARCHAR AS fabric,
  CASE WHEN p_type = 'PROMO' THEN '无飞边口袋有系带式' WHEN p_type = 'LARGE' THEN '无飞边平口信封式' ELSE '' END AS style, CASE WHEN p_size % 2 = 0 THEN '灰色' ELSE '漂白色' END AS color,
  CASE WHEN p_size % 3 = 0 THEN '重叠片' || p_size::VARCHAR ELSE '' END AS note FROM part
""")
def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of an order line out of a description."""
    size, kind = F.col("p_size"), F.col("p_type")
    text = F.concat(
        F.lit("Twill "), 200 + size, F.lit("TC "), size, F.lit("% cotton / "), 100 - size, F.lit("% polyester "), F.when(kind == "PROMO", "bag, with ties ").when(kind == "LARGE", "envelope ").otherwise(""),
        F.when(size % 2 == 0, "grey ").otherwise("white "), F.when(size % 3 == 0, F.concat(F.lit("overlap: "), size, F.lit("cm"))).otherwise(""),
    )
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").withColumn("t", text)
    how = {"composition": N.order_composition, "fabric": N.order_fabric, "style": N.order_style, "color": N.order_color, "note": N.order_note}
    return rows.select("p_partkey", *[f(F.col("t")).alias(n) for n, f in how.items()])


@query("SELECT p_partkey, concat_ws('；', CASE WHEN p_brand <> '' THEN '品类:' || p_brand END, CASE WHEN p_type <> 'PROMO' THEN '规格:' || p_type END) AS document_text FROM part")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").withColumn("kind", F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")))
    return rows.select("p_partkey", labelled_text({"品类": "p_brand", "规格": "kind"}, ":").alias("document_text"))


@query("SELECT event_type AS state, epoch(time_bucket(INTERVAL 5 MINUTES, ts))::BIGINT AS started, count(*) AS events FROM events GROUP BY 1, 2")
def state_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate over a table."""
    events = table(spark, sf_dir, "events", "ts", "event_type").select(F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("at"))
    return runs.activity(events).select("state", F.unix_seconds("start").alias("started"), "events")
