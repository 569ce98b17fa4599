"""Command line: workbooks, master store, index, matches, reviews, and what the dictionaries say."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftspark.session import ship_package


#: What shadow-compare writes and integration-preview reads.
COMPARED = "record_id string, field string, source_text string, value string, value_status string, source_cells array<string>, status string, candidates array<string>, matched array<string>, missing array<string>, conflicting array<string>"


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftspark")
    commands = parser.add_subparsers(dest="command", required=True)
    shapes = {
        "parse": ("workbooks", "output"),
        "build": ("master_csv", "output"),
        "build-index": ("store", "output"),
        "search-index": ("index", "query"),
        "match-orders": ("records", "store", "index", "output"),
        "build-review": ("matches", "records", "store", "output"),
        "validate-review": ("review", "store", "candidates"),
        "evaluate-review": ("review", "candidates"),
        "build-preview": ("rules", "styles", "output"),
        "shadow-compare": ("records", "rules", "styles", "output"),
        "integration-preview": ("shadow", "output"),
    }
    for name, places in shapes.items():
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
        if "output" in places:
            command.add_argument("--overwrite", action="store_true")
        if name in ("build-index", "search-index", "match-orders"):
            command.add_argument("--encoder", help="package.module:function that makes an encoder; a hash of trigrams if not given")
        if "styles" in places:
            command.add_argument("--rules-sha256", required=True, help="the approved workbook's hash")
            command.add_argument("--styles-sha256", required=True)
        if name == "search-index":
            command.add_argument("--scope", choices=("all", "category"), default="category")
            command.add_argument("--top-k", type=int, default=10)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("weftspark").getOrCreate()
    ship_package(spark)
    print(json.dumps(run(spark, asked), ensure_ascii=False))
    return 0


def encoder_of(name: str | None):
    """The function that makes an encoder, by its place in a module."""
    from weftspark.functions.encoder import hash_encoder

    if not name:
        return hash_encoder
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def run(spark: SparkSession, asked: argparse.Namespace) -> dict[str, object]:
    """What a command did, in numbers."""
    from weftspark.functions.encoder import assert_valid, encode_texts
    from weftspark.operators import dictionary, master, review, shadow
    from weftspark.plans import match
    from weftspark.plans.parse import dictionary_evidence, parse_workbooks, status_report
    from weftspark.session import stored
    from weftspark.sources import dictionaries, vector_index
    from weftspark.sources.master_csv import checked, read_master
    from weftspark.sources.sinks import unchanged, write_pair

    overwrite = getattr(asked, "overwrite", False)
    if asked.command == "parse":
        before = unchanged(spark, asked.workbooks)
        records = stored(parse_workbooks(spark, asked.workbooks), "records")
        unchanged(spark, asked.workbooks, before)  # all workbooks have been read by now
        write_pair(spark, {"records": records, "report": status_report(records)}, asked.output, asked.overwrite)
        return {"records": records.count()}
    if asked.command == "build":
        rows, found = read_master(spark, asked.master_csv)
        store = master.normalized(checked(rows))
        master.write_store(store, asked.output, asked.overwrite)
        return {"materials": spark.read.parquet(asked.output).count(), "sha256": found["sha256"]}
    make = encoder_of(getattr(asked, "encoder", None))
    if asked.command == "build-index":
        store = spark.read.parquet(asked.store)
        coded = encode_texts(store.select("material_code", F.col("document_text").alias("text")), make)
        size = coded.select(F.size("vector").alias("n")).first()
        vectors = stored(assert_valid(coded, size["n"] if size else 0), "vectors")
        return {scope: found["rows"] for scope, found in vector_index.write_index(store, vectors, asked.output, overwrite).items()}
    if asked.command == "search-index":
        index = vector_index.read_index(spark, asked.index, asked.scope)
        query = encode_texts(spark.createDataFrame([(0, asked.query)], "query_id int, text string"), make)
        found = vector_index.search(index, query, asked.top_k).orderBy("rank").collect()  # top_k rows
        return {"found": [{"material_code": r["item_id"], "similarity": round(r["similarity"], 6)} for r in found]}
    if asked.command == "match-orders":
        records = spark.read.json(f"{asked.records}/records").withColumn("order_id", F.concat_ws("#", "file", "row"))
        queries = stored(match.order_queries(records), "queries")
        vectors = stored(encode_texts(queries.select("order_id", F.col("query_text").alias("text")), make), "vectors")
        found = match.match_orders(queries, spark.read.parquet(asked.store), vectors, vector_index.read_index(spark, asked.index))
        write_pair(spark, {"candidates": found.candidates, "decisions": found.decisions, "conflicts": found.conflicts}, asked.output, asked.overwrite)
        return {r["decision"]: r["orders"] for r in match.summarized(found)["decisions"].collect()}
    if asked.command == "build-review":
        records = spark.read.json(f"{asked.records}/records")
        orders = records.select(F.concat_ws("#", "file", "row").alias("order_id"), F.col("file").alias("source_file"), F.col("record")["行号"].alias("line_number"))
        tables = review.review_tables(spark.read.json(f"{asked.matches}/candidates"), spark.read.json(f"{asked.matches}/decisions"), orders, spark.read.parquet(asked.store))
        write_pair(spark, tables, asked.output, asked.overwrite)
        return {name: spark.read.json(f"{asked.output}/{name}").count() for name in tables}
    if asked.command in ("build-preview", "shadow-compare"):
        books = dictionaries.load(spark, asked.rules, asked.styles, asked.rules_sha256, asked.styles_sha256)
        if asked.command == "build-preview":
            write_pair(spark, {"rules": books.rules, "fabrics": books.fabrics, "styles": books.styles}, asked.output, overwrite)
            return {name: df.count() for name, df in (("rules", books.rules), ("fabrics", books.fabrics), ("styles", books.styles))}
        compared = stored(shadow.compare(dictionary_evidence(spark.read.json(f"{asked.records}/records")), books), "compared")
        parts = shadow.summary(compared)
        write_pair(spark, {"comparisons": compared, "fields": parts["fields"], "open": parts["open"]}, asked.output, overwrite)
        return parts["totals"].first().asDict()
    if asked.command == "integration-preview":
        compared = spark.read.schema(COMPARED).json(f"{asked.shadow}/comparisons")
        action = dictionary.integration_action(*[F.col(c) for c in ("status", "value", "value_status", "candidates", "source_text", "source_cells", "matched", "missing", "conflicting")])
        proposed = compared.withColumn("proposal", action)
        write_pair(spark, {"proposals": proposed, "risks": dictionary.risk_levels(compared)}, asked.output, overwrite)
        return {r["action"]: r["n"] for r in proposed.groupBy(F.col("proposal.action").alias("action")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sheet, candidates = spark.read.parquet(asked.review), spark.read.parquet(asked.candidates)
    if asked.command == "validate-review":
        issues = review.issues(sheet, spark.read.parquet(asked.store), candidates)
        return {r["level"]: r["n"] for r in issues.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    return review.metrics(sheet, candidates).first().asDict()


if __name__ == "__main__":
    raise SystemExit(main())
