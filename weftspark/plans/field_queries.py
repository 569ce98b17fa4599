"""Field functions, comparisons and decisions on the driver's tables, whose columns are written out as the texts they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import sizes as S
from weftspark.functions import text as X
from weftspark.operators import contracts, dictionary, master, recall, resolution, review, revisions, shadow, states, structure
from weftspark.plans.queries import query
from weftspark.sources import documents
from weftspark.sources.tables import table
from weftspark.streaming import runs

TEXT = "string"


def _cases(number: Column, *texts: Column | str) -> Column:
    """The text whose place is the number's remainder."""
    out = F.lit(None).cast(TEXT)
    for k, text in enumerate(texts):
        out = F.when(number % len(texts) == k, text if isinstance(text, Column) else F.lit(text)).otherwise(out)
    return out


def _words(*parts: Column | str) -> Column:
    return F.concat(*[p.cast(TEXT) if isinstance(p, Column) else F.lit(p) for p in parts])


# ---- text functions

@query(r"""
SELECT p_partkey, lower('T 1 ' || trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS text FROM part
""")
def audit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide letters and signs become plain ones, white space collapses, capitals become small."""
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", X.audit_text(_words("Ｔ　① ", F.col("p_name"), "  ")).alias("text"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN p_type ELSE p_type || ' x' END AS text FROM part
""")
def optional_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").select("p_partkey", X.optional_text(_cases(F.col("p_size"), " N/A ", "--", kind, _words(kind, "\n x"))).alias("text"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN l_quantity::BIGINT::VARCHAR || '.25' ELSE l_quantity::BIGINT::VARCHAR || ' pcs' END AS quantity FROM lineitem
""")
def quantity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("bigint")
    written = _cases(F.col("l_linenumber"), _words(n, ".0"), _words(n, ".25"), _words(n, " pcs"))
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", X.quantity(written).alias("quantity"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 180 THEN rtrim(left(text, 179)) || '…' ELSE text END) AS shown_sha256 FROM documents")
def ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(X.ellipsis(F.col("text")), 256).alias("shown_sha256"))


@query("""
SELECT p_partkey, CASE WHEN n <= 26 THEN chr(64 + n) ELSE chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) END AS letters FROM (SELECT p_partkey, (p_partkey % 702 + 1)::INTEGER AS n FROM part)
""")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", X.column_letters((F.col("p_partkey") % 702 + 1).cast("int")).alias("letters"))


DATE = "(2000 + p_size)::VARCHAR || '-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 31 + 1)::VARCHAR, 2, '0')"


@query(f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '美元' WHEN 1 THEN p_type WHEN 2 THEN p_size::VARCHAR || '.5' WHEN 3 THEN 'x 1'
  ELSE CASE WHEN try_cast({DATE} AS DATE) IS NULL THEN (2000 + p_size)::VARCHAR || '/' || (p_size % 12 + 1)::VARCHAR || '/' || (p_partkey % 31 + 1)::VARCHAR ELSE {DATE} END END AS value FROM part
""")
def normalized_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currencies, quantities and dates in other notations; days that no calendar has stay as they are."""
    key, size = F.col("p_partkey"), F.col("p_size")
    field = F.when(key % 5 < 2, "币种").when(key % 5 < 4, "数量").otherwise("计划发货日期")
    date = _words(2000 + size, "/", size % 12 + 1, "/", key % 31 + 1)
    value = _cases(key, " ＵＳ$ ", F.col("p_type"), _words("+00", size, ".500"), "x  1", date)
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").select("p_partkey", resolution.normalized_value(field, value).alias("value"))


@query(f"SELECT p_partkey, CASE WHEN try_cast({DATE} AS DATE) IS NULL THEN NULL ELSE {DATE} END AS day FROM part")
def calendar_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = _words("on ", 2000 + F.col("p_size"), ".", F.col("p_size") % 12 + 1, ".", F.col("p_partkey") % 31 + 1)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", X.calendar_date(written).alias("day"))


# ---- sizes, fabrics, styles

@query("""
WITH s AS (SELECT p_partkey, p_partkey % 6 AS k, p_size::DOUBLE AS n FROM part)
SELECT p_partkey, round(CASE k WHEN 3 THEN NULL WHEN 4 THEN n * 2.54 ELSE n END, 4) AS "first", round(CASE k WHEN 3 THEN NULL WHEN 0 THEN 2 * n WHEN 4 THEN 90 * 2.54 ELSE 90 END, 4) AS "second",
  round(CASE k WHEN 3 THEN NULL WHEN 0 THEN 2 * n WHEN 4 THEN n * 2.54 WHEN 5 THEN 90 ELSE n END, 4) AS length, round(CASE k WHEN 3 THEN NULL WHEN 0 THEN n WHEN 4 THEN 90 * 2.54 WHEN 5 THEN n ELSE 90 END, 4) AS width,
  CASE k WHEN 3 THEN NULL WHEN 0 THEN 30.0 WHEN 2 THEN 20.0 ELSE 0.0 END::DOUBLE AS extension FROM s
""")
def size_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with and without letters, units, extensions, denials and hand holes."""
    n = F.col("p_size")
    texts = _cases(
        F.col("p_partkey"), _words("W: ", n * 10, "mm x L: ", n * 20, "mm, Inner Flap 300 mm"), _words(n, " × 90 cm without flap 30cm"), _words(n, "*90+20cm"), "queen", _words(n, ' x 90", hand hole 5"'), _words(n, " * L 90cm 300tc + 5"),
    )
    size = S.size_of(texts)
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", size.alias("s"))
    return rows.select("p_partkey", *[F.round(F.col("s")[f], 4).alias(f) for f in ("first", "second", "length", "width")], F.col("s.extension").alias("extension"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '缎条' WHEN 1 THEN '贡缎' WHEN 2 THEN '平布' ELSE '' END AS family, CASE WHEN p_partkey % 4 < 3 THEN 'T' || (200 + p_size)::VARCHAR ELSE '' END AS density,
  CASE p_partkey % 4 WHEN 0 THEN 'C' || p_size::VARCHAR || '/T' || (100 - p_size)::VARCHAR WHEN 1 THEN '100C' ELSE '' END AS composition FROM part
""")
def fabric_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("p_size"), F.col("p_partkey")
    text = _cases(key, _words("Sateen  Stripes T", 200 + n, " c", n, "/t", 100 - n), _words(200 + n, "TC satin, 100% cotton"), _words("t60 percale ", 200 + n, " thread count"), "plain towel t60")
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("t", text)
    return rows.select("p_partkey", S.fabric_family(F.col("t")).alias("family"), S.thread_density(F.col("t")).alias("density"), S.text_composition(F.col("t")).alias("composition"))


@query("""
SELECT p_partkey, 'composition=100C,construction=173*120,density=T' || (200 + p_size)::VARCHAR || CASE WHEN p_size % 2 = 0 THEN ',stripe_width=' || (p_size / 2)::INTEGER::VARCHAR || 'cm' ELSE '' END || ',yarn_count=60S*40S' AS parts,
  CASE WHEN p_size % 2 = 0 THEN '缎条' ELSE '斜纹' END AS category FROM part
""")
def fabric_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    text = _words("T", 200 + n, " 60s x 40s 173*120 100% cotton ", F.when(n % 2 == 0, _words((n * 5).cast("int"), "mm stripe")).otherwise("twill"))
    c = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("c", shadow.fabric_components(text))
    entries = F.array_sort(F.filter(F.transform(F.map_entries("c"), lambda e: F.concat_ws("=", e["key"], e["value"])), lambda e: ~e.startswith("category=") & ~e.startswith("weave=")))
    return c.select("p_partkey", F.array_join(entries, ",").alias("parts"), F.col("c")["category"].alias("category"))


STYLE_TEXTS = ("bag style, 3 sides flange, ties", "envelope without flap, zipper, piping", "bottom opening no flap", "cotton only", "pocket with hand holes, internal fold")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bag' WHEN 1 THEN 'envelope' WHEN 2 THEN 'open_bottom_no_flap' WHEN 4 THEN 'bag' ELSE '' END AS form,
  CASE p_partkey % 5 WHEN 0 THEN 'three' WHEN 1 THEN 'none' WHEN 2 THEN 'none' WHEN 4 THEN 'tail_single' ELSE '' END AS flange, CASE WHEN p_partkey % 5 = 3 THEN '' WHEN p_partkey % 5 = 0 THEN 'yes' ELSE 'no' END AS tie,
  CASE WHEN p_partkey % 5 = 3 THEN '' WHEN p_partkey % 5 = 1 THEN 'yes' ELSE 'no' END AS zipper, CASE WHEN p_partkey % 5 = 3 THEN '' WHEN p_partkey % 5 = 4 THEN 'yes' ELSE 'no' END AS welcome, CASE WHEN p_partkey % 5 = 1 THEN 'yes' ELSE '' END AS piping FROM part
""")
def style_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part", "p_partkey").withColumn("c", shadow.style_components(_cases(F.col("p_partkey"), *STYLE_TEXTS)))
    return c.select("p_partkey", *[F.coalesce(F.try_element_at(F.col("c"), F.lit(k)), F.lit("")).alias(k) for k in ("form", "flange", "tie", "zipper", "welcome", "piping")])


@query("""
WITH q AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bag' WHEN 1 THEN 'envelope' WHEN 4 THEN 'bag' END AS form, CASE p_partkey % 5 WHEN 0 THEN 'three' WHEN 1 THEN 'none' WHEN 4 THEN 'tail_single' END AS flange, p_partkey % 5 = 0 AS tie, p_partkey % 5 = 1 AS zip, p_partkey % 5 = 4 AS welcome FROM part)
SELECT p_partkey, n_nationkey::INTEGER AS source_row FROM q JOIN nation n ON q.form = CASE WHEN n_nationkey % 2 = 0 THEN 'bag' ELSE 'envelope' END
WHERE q.flange = CASE n_nationkey % 3 WHEN 0 THEN 'three' WHEN 1 THEN 'none' ELSE 'tail_single' END AND q.tie = (n_nationkey % 4 = 0) AND q.zip = (n_nationkey % 5 = 1) AND NOT q.welcome AND (n_nationkey % 7 <> 0 OR p_partkey % 5 = 1)
""")
def style_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as styles of a dictionary: a style fits if it shows every feature and no extra that the text lacks."""
    key = F.col("n_nationkey")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    entries = {
        "form": F.when(key % 2 == 0, "bag").otherwise("envelope"), "flange": _cases(key, "three", "none", "tail_single"), "tie": yes(key % 4 == 0), "zipper": yes(key % 5 == 1), "pocket": yes(key % 2 == 0),
        "welcome": F.lit("no"), "double_opening": yes((key % 2 == 0) & (key % 3 != 1)), "piping": F.when(key % 7 == 0, "yes"),
    }
    book = table(spark, sf_dir, "nation").select(key.cast("int").alias("source_row"), F.col("n_name").alias("standard_name"), F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("components"))
    asked = table(spark, sf_dir, "part", "p_partkey").withColumn("components", shadow.style_components(_cases(F.col("p_partkey"), *STYLE_TEXTS)))
    return shadow.match_styles(asked, book, "p_partkey").select("p_partkey", "source_row")


@query("""
SELECT p_partkey, list_filter(['三飞边', '被尾单飞边', '无飞边', '口袋', '信封', '有系带', '无系带', '拉链', '迎宾'], lambda f: contains(t, f)) AS features
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '无飞边口袋有系带式' WHEN 1 THEN '信封迎宾' ELSE p_name END AS t FROM part)
""")
def style_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _cases(F.col("p_partkey"), "无飞边口袋有系带式", "信封迎宾", F.col("p_name"))
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", S.style_features(text).alias("features"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN t LIKE '%white%' THEN '漂白色' END, CASE WHEN t LIKE '%gray%' THEN '灰色' END, CASE WHEN t LIKE '%blue%' THEN '蓝色' END, CASE WHEN t LIKE '%beige%' THEN '米色' END], lambda x: x IS NOT NULL), ',') AS colors
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'white blue' WHEN 1 THEN 'gray' WHEN 2 THEN 'beige gray' ELSE '' END AS t FROM part)
""")
def color_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _cases(F.col("p_size"), "Blue and WHITE", "gray", "beige/grey", "whitewash")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.array_join(dictionary.color_candidates(text), ",").alias("colors"))


# ---- dictionary comparisons

@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'conflict' WHEN 3 THEN 'equivalent_match' WHEN 4 THEN CASE WHEN p_type = 'PROMO' THEN 'exact_match' ELSE 'conflict' END WHEN 5 THEN 'partial_match' ELSE 'dictionary_no_match' END AS status FROM part
""")
def simple_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven fields by the remainder of the key, each with a source text and the rules' value."""
    key = F.col("p_partkey")
    field = _cases(key, "币种", "币种", "尺寸类型", "物料名称", "是否绣花", "行备注", "颜色")
    source = _cases(key, "USD 5", "usd or eur", "after wash", "Quilt Cover 200", "no embroidery", "hand hole, overlap 5cm", "teal")
    value = _cases(key, "美元", "美元", "交货尺寸", "某 被套", F.when(F.col("p_type") == "PROMO", "N").otherwise("Y"), "含手洞", "漂白色")
    return table(spark, sf_dir, "part", "p_partkey", "p_type").select("p_partkey", shadow.compare_simple(field, source, value)["status"].alias("status"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'equivalent_match' WHEN 1 THEN 'partial_match' WHEN 2 THEN 'conflict' WHEN 3 THEN 'dictionary_no_match' ELSE 'exact_match' END AS status FROM part
""")
def size_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written width first against values written length first."""
    n = F.col("p_size") + 100
    source = _cases(F.col("p_partkey"), _words(n, " x 300cm"), _words(n, " x 300cm"), _words(n, " x 310cm"), "king", _words(n, " x ", n, " cm"))
    value = _cases(F.col("p_partkey"), _words("300*", n, "cm"), _words("300*", n, "+30cm"), _words("300*", n, "cm"), _words("300*", n, "cm"), _words(n, "*", n, "cm"))
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", S.size_of(source).alias("a"), S.size_of(value).alias("b"))
    return rows.select("p_partkey", shadow.compare_sizes(F.col("a"), F.col("b"))["status"].alias("status"))


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'keep' WHEN 'click' THEN 'manual_review' WHEN 'signup' THEN 'manual_review' ELSE 'keep' END AS action FROM events WHERE user_id % 3 = 0
""")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that are validated, and what follows from each status."""
    kind = F.col("event_type")
    status = F.when(kind == "click", "conflict").when(kind == "signup", "partial_match").when(kind == "view", "exact_match").otherwise("dictionary_no_match")
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", _cases(F.col("user_id"), "颜色", "款式", "面料").alias("field"), status.alias("status"))
    return shadow.validated(rows).select("event_id", "action")


# ---- contracts, decisions, revisions

@query("""
WITH k AS (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
SELECT event_id, '$.z: missing' AS violation FROM k UNION ALL SELECT event_id, '$.k: too small' FROM k WHERE k < 50 UNION ALL SELECT event_id, '$.m: value not allowed' FROM k WHERE event_id % 3 = 1
UNION ALL SELECT event_id, '$: unknown keys y' FROM k WHERE event_id % 5 = 0
""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of a number, a word of a list, and sometimes a key that the schema doesn't know."""
    wanted = {"type": "object", "required": ("k", "z"), "properties": {"k": {"type": "integer", "minimum": 50}, "m": {"type": "string", "enum": ("a", "b")}, "z": {"type": "string"}}}
    event = F.col("event_id")
    body = _words("{\"k\": ", F.get_json_object("props", "$.k"), ", \"m\": \"", _cases(event, "a", "c", "b"), "\"", F.when(event % 5 == 0, ', "y": 1').otherwise(""), "}")
    return contracts.violations(table(spark, sf_dir, "events", "event_id", "props").withColumn("j", body), ["event_id"], "j", wanted)


@query("""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS stage, CASE WHEN event_id % 2 = 0 THEN 'schema' ELSE 'unknown' END AS category,
  CASE event_id % 3 WHEN 0 THEN '$.records[].value' WHEN 1 THEN '$' ELSE '$.a_b' END AS path FROM events
""")
def safe_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _cases(F.col("event_id"), "$.records[17].value", '$.["secret text"]', "$.a_b")
    told = contracts.safe_diagnostic(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "schema").otherwise("key=abc"), path, ("view", "click"), ("schema", "timeout"))
    return table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", told.alias("d")).select("event_id", "d.*")


@query("""
SELECT p_partkey, 'sha256:' || sha256('{"a":' || p_size::VARCHAR || ',"b":"' || p_type || '","c":null}') AS hash, left(sha256(p_partkey::VARCHAR || chr(10) || p_type), 20) AS short FROM part
""")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.struct(F.col("p_size").alias("a"), F.col("p_type").alias("b"), F.lit(None).cast(TEXT).alias("c"))
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").select("p_partkey", structure.stable_hash(value).alias("hash"), structure.short_hash(F.col("p_partkey"), F.col("p_type")).alias("short"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '数量' WHEN 1 THEN '颜色' WHEN 2 THEN '客户' ELSE '币种' END AS field, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'many' ELSE lang END ELSE '' END AS ai,
  CASE WHEN toxic = 1 THEN 'other' WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS rule, doc_id % 3 <> 0 AS ev, doc_id % 7 <> 0 AS refs FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, CASE WHEN ai <> '' AND field = '数量' THEN 'ai_rejected_business_constraint' WHEN ai <> '' AND rule <> '' AND ai = rule THEN 'ai_python_agree' WHEN ai <> '' AND rule = '' THEN 'ai_fills_python_blank'
  WHEN rule <> '' AND ai = '' THEN 'python_retained_ai_omitted' WHEN ai <> '' AND refs AND NOT ev THEN 'direct_evidence_selected_ai' WHEN ev AND NOT (ai <> '' AND refs) THEN 'direct_evidence_selected_python'
  WHEN ai <> '' AND refs AND ev THEN 'unresolved_direct_evidence_conflict' WHEN ai = '' AND rule = '' THEN 'both_missing' ELSE 'no_direct_evidence_conflict' END AS reason FROM d),
s AS (SELECT *, CASE reason WHEN 'ai_rejected_business_constraint' THEN CASE WHEN rule <> '' THEN 'python' ELSE 'none' END WHEN 'ai_python_agree' THEN 'both' WHEN 'ai_fills_python_blank' THEN 'ai' WHEN 'python_retained_ai_omitted' THEN 'python'
  WHEN 'direct_evidence_selected_ai' THEN 'ai' WHEN 'direct_evidence_selected_python' THEN 'python' ELSE 'none' END AS source FROM r)
SELECT doc_id, reason, source, CASE WHEN source IN ('python', 'both') THEN rule WHEN source = 'ai' THEN ai ELSE '' END AS value,
  field IN ('数量', '客户', '币种') AND source = 'none' AND reason IN ('ai_rejected_business_constraint', 'unresolved_direct_evidence_conflict') AS blocking FROM s
""")
def strict_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a model's values, languages as the rules': the policy under which severe differences block a record."""
    doc = F.col("doc_id")
    rows = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("field", _cases(doc, "数量", "颜色", "客户", "币种"))
    ai = F.when(F.col("quality") == 1, F.when(doc % 4 == 0, "many").otherwise(F.col("lang"))).otherwise("")
    rule = F.when(F.col("toxic") == 1, "other").when(doc % 5 == 0, "").otherwise(F.col("lang"))
    references = F.when(doc % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e")))
    candidates = rows.select(doc.alias("record_id"), "field", ai.alias("value"), F.when(F.col("quality") == 1, "extracted").otherwise("missing").alias("extraction_status"), references.alias("references"))
    rules = rows.select(doc.alias("record_id"), "field", rule.alias("value"), (doc % 3 != 0).alias("has_evidence"))
    return resolution.decide_strict(candidates, rules).select(F.col("record_id").alias("doc_id"), "reason", "source", "value", "blocking")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: complete, one field short, one field twice, or missing, by the key."""
    fields = F.array(*[F.lit(f) for f in resolution.BUSINESS_FIELDS])
    key = F.col("o_orderkey")
    chosen = F.when(key % 4 == 0, fields).when(key % 4 == 1, F.slice(fields, 2, len(resolution.BUSINESS_FIELDS))).when(key % 4 == 2, F.concat(fields, F.array(F.lit("客户")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(key.alias("record_id"), "o_orderstatus", F.explode(chosen).alias("field"))
    return rows.select("record_id", "field", _words(F.col("field"), F.col("record_id")).alias("value"), ((F.col("o_orderstatus") == "F") & (F.col("field") == "客户")).alias("review_required"), F.lit("high").alias("severity"), F.lit("ai_selected").alias("status"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'fields_missing' WHEN 2 THEN 'fields_repeated' ELSE 'record_missing' END AS reasons, o_orderkey % 4 = 0 AS ready, o_orderkey % 4 IN (0, 2) AND o_orderstatus = 'F' AS review_required FROM orders
""")
def ready_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("record_id"))
    gate = resolution.ready_gate(_decisions(spark, sf_dir), expected)
    return gate.select(F.col("record_id").alias("o_orderkey"), F.array_join("reasons", ",").alias("reasons"), "ready", "review_required")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN '客户' || o_orderkey::VARCHAR END AS customer, '是否绣花' || o_orderkey::VARCHAR AS embroidery FROM orders WHERE o_orderkey % 4 <> 3
""")
def wide_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.wide_records(_decisions(spark, sf_dir)).select(F.col("record_id").alias("o_orderkey"), F.col("客户").alias("customer"), F.col("是否绣花").alias("embroidery"))


REQUESTS = """
r AS (SELECT event_id, user_id::VARCHAR AS history, CASE WHEN event_id % 4 = 0 THEN 'old' ELSE 'sha256:' || sha256('start' || chr(10) || user_id::VARCHAR) END AS expected, CASE WHEN event_type = 'error' THEN '相似分数' ELSE '颜色' END AS field,
  CASE WHEN event_type = 'signup' THEN 'drop' ELSE 'enter_value' END AS action, event_type AS value FROM events),
i AS (SELECT *, 'sha256:' || sha256(concat_ws(chr(10), history, expected, history, field, value, action)) AS id,
  CASE WHEN field <> '颜色' THEN 'field_not_editable' WHEN action = 'drop' THEN 'unknown_action' WHEN expected = 'old' THEN 'history_moved_on' END AS reason FROM r),
f AS (SELECT *, min(CASE WHEN reason IS NULL THEN id END) OVER (PARTITION BY history) AS first FROM i)
"""


def _revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The start of every user's history, and what becomes of the requests that its events make."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    history = F.col("user_id").cast(TEXT)
    start = revisions.start(spark, events.select(history.alias("history")).distinct())
    seen = _words("sha256:", F.sha2(F.concat(F.lit("start\n"), history), 256))
    kind = F.col("event_type")
    requests = events.select(
        history.alias("history"), F.when(F.col("event_id") % 4 == 0, "old").otherwise(seen).alias("expected"), history.alias("record_id"), F.when(kind == "error", "相似分数").otherwise("颜色").alias("field"),
        kind.alias("value"), F.when(kind == "signup", "drop").otherwise("enter_value").alias("action"),
    )
    return start, *revisions.append(start, requests)


@query(f"""
WITH {REQUESTS}
SELECT history, coalesce(reason, 'history_moved_on') AS reason, count(*) AS n FROM f WHERE reason IS NOT NULL OR id <> first GROUP BY ALL
UNION ALL SELECT DISTINCT history, 'accepted ' || id, 1 FROM f WHERE reason IS NULL AND id = first
""")
def revision_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests become revisions, and why the others don't."""
    _, new, refused = _revisions(spark, sf_dir)
    taken = new.select("history", _words("accepted ", F.col("revision")).alias("reason"), F.lit(1).cast("bigint").alias("n"))
    return refused.groupBy("history", "reason").agg(F.count(F.lit(1)).alias("n")).unionByName(taken)


@query(f"""
WITH {REQUESTS}, v AS (SELECT DISTINCT history, value FROM f WHERE reason IS NULL AND id = first), u AS (SELECT DISTINCT user_id::VARCHAR AS record_id FROM events)
SELECT record_id, coalesce(v.value, 'old') AS value, CASE WHEN v.value IS NULL THEN 'ai_selected' ELSE 'revised' END AS status, v.value IS NULL AS review_required FROM u LEFT JOIN v ON record_id = history
""")
def revised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, new, _ = _revisions(spark, sf_dir)
    decisions = start.select(F.col("history").alias("record_id"), F.lit("颜色").alias("field"), F.lit("old").alias("value"), F.lit("ai_selected").alias("status"), F.lit(True).alias("review_required"), F.lit("high").alias("severity"))
    return revisions.current_values(decisions, start.unionByName(new)).select("record_id", "value", "status", "review_required")


@query(f"""
WITH {REQUESTS}, v AS (SELECT count(DISTINCT history) AS n FROM f WHERE reason IS NULL), u AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT u.n - v.n AS review_required, u.n - v.n AS high, u.n AS records FROM u, v
""")
def revision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, new, _ = _revisions(spark, sf_dir)
    decisions = start.select(F.col("history").alias("record_id"), F.lit("颜色").alias("field"), F.lit("old").alias("value"), F.lit("ai_selected").alias("status"), F.lit(True).alias("review_required"), F.lit("high").alias("severity"))
    return revisions.review_summary(revisions.current_values(decisions, start.unionByName(new)))


STATES = {"view": "pending", "click": "in_progress", "signup": "validated", "purchase": "failed_transient", "error": "interrupted"}
LEGAL = [f"{a}>{b}" for a, follow in runs.TRANSITIONS.items() if a for b in follow]


@query(f"""
WITH s AS (SELECT event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} END AS state, user_id, ts FROM events),
p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM s)
SELECT event_id, state, previous_state, CASE WHEN previous_state IS NULL THEN state = 'pending' ELSE previous_state || '>' || state IN ({', '.join(f"'{x}'" for x in LEGAL)}) END AS legal FROM p
""")
def unit_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of a unit of work."""
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts").withColumn("state", names[F.col("event_type")])
    allowed = {k: v for k, v in runs.TRANSITIONS.items() if k}
    return states.check_transitions(events, ["user_id"], ["ts", "event_id"], "state", allowed, runs.TRANSITIONS[""]).select("event_id", "state", "previous_state", "legal")


# ---- master, review, recall

def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as materials."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    size = F.col("p_size")
    spec = _cases(size, "", _words(size, "*90cm"), _words(size, "*90cm+5cm"), "queen")
    name = _cases(F.col("p_partkey"), "枕套 A", "flat sheet", "widget", "pillow")
    return part.select(
        _words("M", F.col("p_partkey")).alias("material_code"), F.col("p_partkey").alias("source_row"), F.when(F.col("p_type") == "PROMO", "被套").otherwise("").alias("product_category"), spec.alias("spec"),
        F.create_map(F.lit("物料名称"), name).alias("raw"), _words("品类:", F.col("p_name")).alias("document_text"), *[F.lit("").alias(c) for c in ("color", "fabric_category", "density", "composition", "style", "size_type")],
    )


@query("""
SELECT kind, count(*) AS n, min(p_partkey) AS first_row FROM (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '被套' ELSE CASE p_partkey % 4 WHEN 0 THEN '枕套' WHEN 1 THEN '床单' WHEN 2 THEN '' ELSE '芯类' END END AS kind FROM part) GROUP BY kind
""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.category_counts(_master(spark, sf_dir))


@query("SELECT CASE p_size % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'cm_size' WHEN 2 THEN 'size_with_extension' ELSE 'other' END AS format, count(*) AS n FROM part GROUP BY 1")
def spec_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.spec_formats(_master(spark, sf_dir))


@query("""
SELECT '{"id":"M' || p_partkey::VARCHAR || '","text":"品类:' || p_name || '","metadata":{"source_row":' || p_partkey::VARCHAR || ',"product_category":"' || CASE WHEN p_type = 'PROMO' THEN '被套' ELSE '' END || '","spec":"'
  || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_size::VARCHAR || '*90cm' WHEN 2 THEN p_size::VARCHAR || '*90cm+5cm' ELSE 'queen' END || '","color":"","fabric_category":"","density":"","composition":"","style":"","size_type":""}}' AS value FROM part
""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.documents(_master(spark, sf_dir))


@query("""
SELECT CASE p_size % 4 WHEN 1 THEN 'material_store' ELSE 'both' END AS side, 'M' || p_partkey::VARCHAR AS id, CASE WHEN p_size % 4 = 1 THEN 'missing' ELSE 'text' END AS difference FROM part WHERE p_size % 4 IN (1, 2)
UNION ALL SELECT 'documents', 'X' || p_partkey::VARCHAR, 'missing' FROM part WHERE p_size % 4 = 3
""")
def store_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store against its exported documents, of which some are missing, some have another text, and some belong to nothing."""
    store = _master(spark, sf_dir)
    size = F.col("p_size")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    own = part.filter(size % 4 != 1).select(_words("M", F.col("p_partkey")).alias("id"), _words("品类:", F.col("p_name"), F.when(size % 4 == 2, "!").otherwise("")).alias("text"), F.create_map(F.lit("source_row"), F.col("p_partkey").cast(TEXT)).alias("metadata"))
    strange = part.filter(size % 4 == 3).select(_words("X", F.col("p_partkey")).alias("id"), F.lit("").alias("text"), F.create_map(F.lit("source_row"), F.lit("0")).alias("metadata"))
    return documents.store_differences(store, own.unionByName(strange))


@query("""
SELECT 'M' || p_partkey::VARCHAR AS material_code, p_partkey, CASE p_size % 4 WHEN 3 THEN 'spec' WHEN 2 THEN 'spec' WHEN 1 THEN 'spec' ELSE '' END AS filled FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)
""")
def indexed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials that an index has a vector of."""
    wanted = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").filter("l_quantity >= 45").select(_words("M", F.col("l_partkey")).alias("material_code"))
    found = recall.indexed(_master(spark, sf_dir), wanted, "material_code")
    return found.select("material_code", F.col("source_row").alias("p_partkey"), F.when(F.col("spec") != "", "spec").otherwise("").alias("filled"))


@query("""
SELECT p.a AS query_id, p.b AS item_id, round(CASE WHEN p.known THEN 0.5 ELSE list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) END, 6) AS similarity
FROM (SELECT vec_id AS a, vec_id + 1 AS b, vec_id % 3 = 0 AS known FROM embeddings) p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b
""")
def similarity_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one; only pairs without a similarity are looked up."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    ids = vectors.select("vec_id")
    pairs = ids.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("item_id"), F.when(F.col("vec_id") % 3 == 0, 0.5).alias("similarity")).join(ids.withColumnRenamed("vec_id", "item_id"), "item_id", "left_semi")
    own = lambda name: vectors.select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))
    found = recall.backfilled(pairs, own("query_id"), own("item_id"), "query_id", "item_id")
    return found.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query("""
WITH r AS (SELECT doc_id, doc_id::VARCHAR AS audit_id, CASE WHEN doc_id % 12 = 4 THEN '' ELSE 'M' || (doc_id % 4)::VARCHAR END AS rec, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'M' || (doc_id % 6)::VARCHAR END AS cor, doc_id % 6 AS c FROM labels),
i AS (SELECT 'error' AS level, audit_id, unnest(list_filter([
  CASE WHEN c = 5 THEN 'unknown_conclusion' END, CASE WHEN cor <> '' AND cor = 'M5' THEN 'unknown_material' END, CASE WHEN c = 1 AND cor = '' THEN 'recommended_without_code' END, CASE WHEN c = 1 AND cor <> '' AND cor <> rec THEN 'recommended_differs' END,
  CASE WHEN c = 2 AND cor = '' THEN 'other_without_code' END, CASE WHEN c = 2 AND cor <> '' AND cor NOT IN ('M0', 'M1', 'M2') THEN 'other_not_a_candidate' END, CASE WHEN c = 3 AND cor = '' THEN 'outside_without_code' END,
  CASE WHEN c = 3 AND cor IN ('M0', 'M1', 'M2') THEN 'outside_is_a_candidate' END, CASE WHEN c = 4 AND cor <> '' THEN 'no_material_with_code' END], lambda x: x IS NOT NULL)) AS rule FROM r),
g AS (SELECT 'error' AS level, n::VARCHAR AS audit_id, 'id_missing' AS rule FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM labels))) AS n) WHERE n > 0 AND n NOT IN (SELECT doc_id FROM labels))
SELECT rule, level, count(*) AS n FROM (SELECT * FROM i UNION ALL SELECT * FROM g UNION ALL SELECT 'warning', audit_id, 'code_without_conclusion' FROM r WHERE c = 0 AND cor <> '') GROUP BY ALL
""")
def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as rows of a review with every kind of mistake."""
    doc = F.col("doc_id")
    labels = table(spark, sf_dir, "labels", "doc_id")
    code = lambda n: _words("M", doc % n)
    conclusion = _cases(doc, "", review.RECOMMENDED, review.OTHER, review.OUTSIDE, review.NO_MATERIAL, "?")
    sheet = labels.select(doc.cast(TEXT).alias("audit_id"), F.when(doc % 12 == 4, "").otherwise(code(4)).alias("recommended"), F.when(doc % 5 == 0, "").otherwise(code(6)).alias("correct"), conclusion.alias("conclusion"), F.lit("").alias("fix_fields"))
    materials = spark.range(5).select(_words("M", F.col("id")).alias("material_code"))
    candidates = labels.select(doc.cast(TEXT).alias("audit_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("audit_id", _words("M", F.col("k")).alias("material_code"))
    return review.issues(sheet, materials, candidates).groupBy("rule", "level").agg(F.count(F.lit(1)).alias("n"))
