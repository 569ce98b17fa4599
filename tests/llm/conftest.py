"""Small documents with every awkward case."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = {"en": "the and ing er st on re th ou ly".split(), "de": "sch ein ung ich ver be keit zu lich en".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    passage = prose(rng, "en", 60)
    line = "This Line Is Repeated In Many Documents And Is Long Enough."
    out = []
    for i in range(40):
        lang = "de" if i % 4 == 0 else "en"
        text = prose(rng, lang, rng.randint(30, 90))
        if i % 5 == 0:
            text += "\n  " + (line.upper() if i % 10 else line) + "\t\n" + prose(rng, lang, 20)
        if i % 7 == 0:
            text += " " + passage
        out.append((i, text, lang, "src", len(text)))
    out.append((100, out[3][1], "en", "src", 0))  # exact copies
    out.append((101, out[3][1], "en", None, None))
    out.append((101, out[3][1], "en", None, None))  # a repeated row
    out.append((102, out[6][1].replace("th", "ht", 1), "en", "src", 0))  # a near copy
    out.append((103, None, "en", None, None))
    out.append((104, "", None, None, None))
    out.append((105, "12 34 !! \n\n", "en", None, None))
    out.append((106, "ä", "de", None, None))
    out.append((None, out[3][1], "en", None, None))
    out.append((107, "word " * 20000, "en", None, None))  # very long, one shingle
    out.append((108, "x" * 30000, "en", None, None))  # one very long word
    out.append((109, "ΑΣ ǅ ﬁ 日本語 <|endoftext|> it's " + passage[:200], "en", None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same documents with columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = "score lang_pred kept n_lines n_dropped spans items n_words g doc digest bucket shard slot size law fingerprint component_id id prints token_ids decoded bytes h1 h2 keeper key members first"
    return docs.select("*", *[F.lit("clash").alias(n) for n in names.split()])


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A data folder for the queries and the pipeline."""
    path = tmp_path_factory.mktemp("data")
    docs.write.parquet(f"{path}/documents.parquet")
    body = " ".join(docs.filter("doc_id = 9").first()["text"].split()[5:25])
    items = [(1, body), (2, "entirely different words that no document holds in this order at all today"), (3, None), (None, body), (4, "12 34"), (5, ""), (6, body)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(40)] + [(7, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)
