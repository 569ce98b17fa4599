"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents; rows without an id pass the filters unless their text
itself is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import bpe, decontaminate, language, lines, simhash
from weftspark.llm.queries import tokenizer_path
from weftspark.llm.rows import PRIVATE
from weftspark.session import ship_package, stored
from weftspark.sources.tables import table

def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those without a letter go, in whichever languages a text is written."""
    ship_package(spark)
    model = language.fit(docs, F.col("doc_id").isNotNull() & ~language.held_out("doc_id", 4, 2))
    if not model.languages:  # nothing to tell languages by, so only texts without letters are rejected
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language.identify(docs, model).filter(F.col(f"{PRIVATE}lang_pred") != language.UNDETERMINED).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the lines that repeat elsewhere; n_chars follows the text."""
    ship_package(spark)
    cut = F.col(f"{PRIVATE}n_dropped") > 0
    out = lines.dedup_lines(docs).withColumn("text", F.when(cut, F.col(f"{PRIVATE}kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document, the one with the smallest id."""
    ship_package(spark)
    return simhash.first_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    ship_package(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.filter(F.size(f"{PRIVATE}spans") == 0).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the decoded text of every document."""
    ship_package(spark)
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bpe", token_stage),
]

#: SQL has neither the language model, nor XXH64, nor the tokenizer: the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token rows of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
