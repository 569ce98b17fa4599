"""One query per operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import audio, bpe, decontaminate, language, lines, quality, sampling, sharding, simhash, substrings, toxicity
from weftspark.llm.rows import PRIVATE
from weftspark.sources.tables import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sample, counts = sampling.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, toxicity.PER_CLASS)
    score = F.col(f"{PRIVATE}toxic_score")
    return toxicity.score_toxicity(docs, toxicity.fit(sample, counts)).select(
        "doc_id", language.held_out("doc_id", 4, 2).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sample, counts = sampling.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, quality.PER_CLASS)
    score = F.col(f"{PRIVATE}quality_score")
    return quality.score_quality(docs, quality.fit(sample, counts)).select(
        "doc_id", language.held_out("doc_id", 5, 0).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return removed.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The bytes as hexadecimal text, cut into pieces that overlap by 49 bytes, so that no window is far from its piece's start.
OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, s, substr(h, 2 * s + 1, 2098) AS x FROM (SELECT r, doc_id, h, unnest(range(0, greatest(length(h) // 2, 1), 1000)) AS s FROM d)),
w AS (SELECT r, doc_id, s + i AS pos, substr(x, 2 * i + 1, 100) AS win FROM (SELECT *, unnest(range(0, least(1000, length(x) // 2 - 49))) AS i FROM p WHERE length(x) >= 100)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
t AS (SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN f ON w.win = f.win WHERE w.doc_id > f.first),
m AS (SELECT r, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT r, pos, sum(fresh) OVER (PARTITION BY r ORDER BY pos) AS k FROM t) GROUP BY r, k),
e AS (SELECT m.*, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM m),
g AS (SELECT e.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front, max(b) AS behind, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM e JOIN d ON e.r = d.r GROUP BY e.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN front IS NULL THEN h ELSE front || substr(h, 2 * behind + 1) END)) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs, F.col("doc_id").isNotNull() & ~language.held_out("doc_id", 4, 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        language.held_out("doc_id", 4, 2).alias("held_out"),
        F.col(f"{PRIVATE}lang_pred").alias("lang_pred"),
        F.col(f"{PRIVATE}lang_score").alias("score"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"), sharding.tree_of(24))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = F.aggregate(f"{PRIVATE}spans", F.lit(0).cast("bigint"), lambda n, s: n + s["after"] - s["first"])
    return found.select(
        "doc_id",
        F.col(f"{PRIVATE}n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(f"{PRIVATE}items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f"{PRIVATE}items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM iw), dw AS (
  SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)
), m AS (SELECT dw.r, dw.s, dw.k, iw.item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win), h AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r
), n AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN n ON d.r = n.r
"""


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id",
        F.col(f"{PRIVATE}n_lines").alias("n_lines"),
        F.col(f"{PRIVATE}n_dropped").alias("n_dropped"),
        F.sha2(f"{PRIVATE}kept", 256).alias("kept_sha256"),
    )


OP7_SQL = """
WITH l AS (
  SELECT r, doc_id, s AS i, ls[s] AS line,
         translate(trim(ls[s], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS s
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), held AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5 AND max(doc_id) IS NOT NULL
), marked AS (
  SELECT l.*, held.keeper IS NOT NULL AND l.doc_id IS DISTINCT FROM held.keeper AS gone FROM l LEFT JOIN held ON l.k = held.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no audio: each vector of embeddings is played as a tune, whose samples are fingerprinted."""
    prints = audio.fingerprints(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding", "vec_id", audio.melody)
    return audio.align(prints).select(
        F.col("id").alias("vec_id"),
        F.size("prints").cast("bigint").alias("n_prints"),
        F.sha2(F.array_join(F.col("prints").cast("array<string>"), ","), 256).alias("prints_sha256"),
        "class_id",
        "n_links",
        "match_id",
        "shift",
        "bit_error",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substrings": op2_substrings,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_lines": op7_lines,
    "op8_audio": op8_audio,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {"op2_substrings": OP2_SQL, "op6_decontaminate": OP6_SQL, "op7_lines": OP7_SQL}
