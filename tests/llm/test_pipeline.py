"""The pipeline against plain versions of its stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from weftspark.llm import queries


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_stages_equal_plain_versions(spark, docs, folder, rows):
    tokenizers = pytest.importorskip("tokenizers")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    plain = [(r[0], r[1]) for r in rows]
    step = stages["language"](spark, docs, folder)
    plain = [r for r in plain if any(c.isalpha() for c in r[1] or "")]
    assert step.columns == docs.columns and texts(step) == sorted(plain, key=lambda r: (r[0] is None, r))
    step = stages["line_dedup"](spark, step, folder)
    plain = [(d, t) for d, _, _, t in brute.line_dedup(plain)]
    assert step.columns == docs.columns and texts(step) == sorted(plain, key=lambda r: (r[0] is None, r))
    step = stages["simhash_near_dedup"](spark, step, folder)
    plain = brute.first_of_each(plain)
    assert step.columns == docs.columns and texts(step) == sorted(plain, key=lambda r: (r[0] is None, r))
    step = stages["benchmark_decontamination"](spark, step, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    plain = [r for r, d in zip(plain, brute.decontaminate(plain, items), strict=True) if not d[5]]
    assert step.columns == docs.columns and texts(step) == sorted(plain, key=lambda r: (r[0] is None, r))
    last = stages["bpe"](spark, step, folder)
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = sorted(((d, library.encode(t, add_special_tokens=False).ids) for d, t in plain), key=lambda r: (r[0] is None, r))
    got = sorted(((r.doc_id, r.token_ids) for r in last.collect()), key=lambda r: (r[0] is None, r))
    assert got == want
    whole = sorted(((r.doc_id, r.token_ids) for r in corpus_pipeline.run(spark, folder).collect()), key=lambda r: (r[0] is None, r))
    assert whole == want


def test_rows_of_a_repeated_id_are_judged_one_by_one(spark, rows, folder):
    long, other = rows[1][1], rows[2][1]
    data = [(3, long), (7, long), (7, other), (9, long), (3, long), (None, other), (None, rows[3][1])]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert texts(dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder)) == texts(spark.createDataFrame([(3, long), (7, other), (None, rows[3][1])], "doc_id long, text string"))


def test_texts_pass_where_no_language_is_known(spark, folder):
    data = [(1, "some words"), (2, "12 34"), (3, None), (4, "")]
    docs = spark.createDataFrame([(d, t, None, "s", 0) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert texts(dict(corpus_pipeline.STAGES)["language"](spark, docs, folder)) == [(1, "some words")]


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, clashing, none, folder):
    for docs in (clashing, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert out.filter(F.lit(True)).count() <= docs.count()


def test_queries_and_sql_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
