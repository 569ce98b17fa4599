"""Master, comparison, matching."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.contracts import FORMAL_SCHEMA, MASTER_COLUMNS
from weftspark.functions import fields as N
from weftspark.functions import sizes as S
from weftspark.operators import master, ranking, scoring
from weftspark.plans import match
from weftspark.sources.master_csv import MasterError, checked, read_master

HEADER = ",".join(MASTER_COLUMNS)
ROWS = [
    "M1,床品 被套,230*200cm,漂白色,贡缎,无飞边口袋无系带式,客标,洗涤尺寸,贡缎,60S*40S,T300,100%C",
    "M2,Duvet Cover,2000mm x 2300mm,White,sateen,无飞边口袋无系带式,客标,洗涤尺寸,贡缎,60s x 40s,300TC,C100",
    "M3,被套,230*200+30cm,灰色,贡缎,三飞边口袋有系带式,客标,交货尺寸,贡缎,,T300,C50/T50",
    "M4,Pillow case,75*50cm,漂白色,斜纹,,,,,,T200,100C",
    "M5,被套,,,,,,,,,,",
    "M6,Gadget,1*2cm,漂白色,,,,,,,,",
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("m") / "master.csv"
    path.write_text("﻿" + "\n".join([HEADER, *ROWS]) + "\n", encoding="utf-8")
    rows, found = read_master(spark, str(path))
    assert found["encoding"] == "UTF-8" and found["delimiter"] == "," and len(found["sha256"]) == 64
    return master.normalized(checked(rows)).cache()


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_master_normalisation(store):
    rows = {r.material_code: r for r in store.collect()}
    assert [rows[m].source_row for m in ("M1", "M6")] == [2, 7]
    assert [rows[m].product_category for m in ("M1", "M2", "M4", "M5")] == ["被套", "被套", "", "被套"]
    assert (rows["M2"].spec, rows["M2"].color, rows["M2"].density, rows["M2"].composition, rows["M2"].yarn_count) == ("200*230cm", "漂白色", "T300", "C100", "60S*40S")
    assert rows["M3"].spec == "230*200cm+30cm" and rows["M1"].composition == "C100" and rows["M3"].composition == "C50/T50"
    assert rows["M1"].document_text == "品类:被套；规格:230*200cm；颜色:漂白色；面料:贡缎；面料品类:贡缎；纱支:60S*40S；密度:T300；成分:C100；款式:无飞边口袋无系带式；加标方式:客标；尺寸类型:洗涤尺寸"
    assert rows["M5"].document_text == "品类:被套" and rows["M1"].raw["物料名称"] == "床品 被套"


def test_master_contract(spark, tmp_path):
    def read(text, encoding="utf-8"):
        path = tmp_path / "x.csv"
        path.write_bytes(text.encode(encoding))
        return read_master(spark, str(path))

    with pytest.raises(MasterError):
        read("a,b\n1,2\n")
    for bad in ("M1,short", ",".join([""] * 12), ROWS[0] + "\n" + ROWS[0]):
        with pytest.raises(MasterError):
            checked(read(f"{HEADER}\n{bad}\n")[0])
    rows, found = read(f"{HEADER}\n{ROWS[0]}\n".replace(",", ";"), "gb18030")
    assert found["encoding"] == "GB18030" and found["delimiter"] == ";" and checked(rows).first()["物料编码"] == "M1"


def test_store_documents_and_statistics(store, tmp_path, spark):
    master.write_store(store, f"{tmp_path}/store")
    back = spark.read.parquet(f"{tmp_path}/store")
    assert back.count() == 6 and "product_category" in back.columns
    text = [r.value for r in master.documents(store.filter("material_code = 'M5'")).collect()][0]
    assert text.startswith('{"id":"M5","text":"品类:被套","metadata":{"source_row":6,')
    assert {r.kind: r.n for r in master.category_counts(store).collect()} == {"被套": 4, "枕套": 1, "": 1}
    assert {r.format: r.n for r in master.spec_formats(store).collect()} == {"cm_size": 4, "size_with_extension": 1, "empty": 1}


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (N.order_color, "Light Grey stripes", "浅灰色"), (N.order_color, "blue", "漂白色"), (N.order_composition, "60% cotton / 40% polyester", "C60/T40"), (N.order_composition, "100％ coton", "100C"),
        (N.order_composition, "80/20 cotton/poly", "C80/T20"), (N.order_fabric, "T250 percale 100% cotton", "贡缎/T250/100C"), (N.order_style, "envelope with hand holes", "无飞边平口信封迎宾式"),
        (N.order_style, "bag, 3 sides flange, zipper", "三飞边双层口叠边口袋有拉链式"), (N.order_style, "bag no flange without ties no hand hole", "无飞边口袋无系带式"), (N.order_style, "plain", ""),
        (N.order_size_type, "before wash", "交货尺寸"), (N.order_embroidery, "no embroidery", "N"), (N.order_embroidery, "embroidered logo", "Y"), (N.order_note, "overlap: 12 inch, hand holes", "重叠片30.48，含手洞"),
        (N.master_color, "ｗｈｉｔｅ", "漂白色"), (N.master_color, "dark gray", "深灰色"), (N.master_color, "teal", "teal"), (N.master_density, "tc 250", "T250"), (N.master_density, "133 x 72", "133*72"),
        (N.master_spec, "98.43in×90.55in", "250*230cm"), (N.master_spec, "A X b", "A * b"), (N.master_composition, "t 20 / c 80", "C80/T20"), (S.fabric_family, "Sateen stripe 3cm", "缎条"),
        (S.thread_density, "40s 300TC T250", "T250"), (S.thread_density, "T60", ""), (S.text_composition, "c80/t20", "C80/T20"), (S.text_composition, "100% long staple cotton", "100C"),
    ],
)
def test_field_normalisers(spark, function, text, want):
    assert one(spark, function(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("size", "spec", "want"),
    [("200 W x 230 L cm", "", "230*200cm"), ("W200cm L230cm", "flap 30cm", "230*200+30cm"), ("1600 x 2000 mm", "", "200*160cm"), ("60x80 in", "", "203.2*152.4cm"), ("king", "", "king"), ("200cm x 2300mm", "", "230*200cm")],
)
def test_order_sizes(spark, size, spec, want):
    assert one(spark, N.order_size(F.col("s"), F.col("p")), s=size, p=spec) == want


def test_size_parser():
    assert S.parse_size_text("w 200 x l 230 cm") == (200, 230, 230, 200, 0)
    assert S.parse_size_text("230*200+30cm")[4] == 30 and S.parse_size_text("2300 x 2000 mm, inner flap 300 mm")[::4] == (230, 30)
    assert S.parse_size_text("230*200cm no flap 30cm")[4] == 0 and S.parse_size_text("230*200cm, hand hole 30cm flap")[4] == 0
    assert S.parse_size_text("no size") is None


def test_field_comparison(spark):
    fields = (*scoring.COMPARED, "fabric_category")
    query = dict(product_category="被套", spec="230*200cm", color="漂白色", fabric="贡缎/T300", composition="C100", density="T300", style="无飞边口袋无系带式", label_method="客标", size_type="洗涤尺寸", fabric_category="贡缎")
    changes = {
        "same": {}, "spec": {"spec": "200 x 230 cm"}, "other size": {"spec": "100*100cm"}, "extended": {"spec": "230*200+30cm"}, "odd": {"spec": "?", "color": "?", "fabric_category": "?"},
        "white": {"color": "white"}, "grey": {"color": "灰色"}, "shared": {"style": "无飞边口袋有系带式"}, "unlike": {"style": "拉链"}, "dull": {"style": "x"}, "empty": {f: "" for f in fields},
        "label": {"label_method": "无"}, "kind": {"product_category": "床单"},
    }
    rows = [(name, *[(query | change)[f] for f in fields]) for name, change in changes.items()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("name", *fields)))
    q = scoring.prepared(spark.createDataFrame([tuple(query[f] for f in fields)], ", ".join(f"{f} string" for f in fields)), "q_").drop(*fields)
    pairs = scoring.prepared(df, "m_").join(q, F.lit(True)).withColumn("similarity", F.lit(0.5))
    got = {r["name"]: r for r in scoring.evaluated(pairs, "q_", "m_", "similarity").collect()}
    status = lambda name, field: got[name]["fields"][field]
    assert set(got["same"]["fields"]) == {"exact_match"} and got["same"]["structured_score"] == 1 and got["same"]["comparable_fields"] == 8
    assert got["same"]["match_score"] == pytest.approx(0.75 + 0.25 * 0.75)
    assert [status(n, "spec") for n in ("spec", "other size", "extended", "odd")] == ["equivalent_match", "hard_conflict", "partial_match", "not_comparable"]
    assert [status(n, "color") for n in ("white", "grey", "odd")] == ["equivalent_match", "hard_conflict", "hard_conflict"]
    assert status("odd", "fabric") == "not_comparable" and [status(n, "style") for n in ("shared", "unlike", "dull")] == ["partial_match", "no_match", "not_comparable"]
    assert set(got["empty"]["fields"]) == {"missing_candidate"} and got["empty"]["structured_score"] is None and got["empty"]["match_score"] == 0.75
    assert status("label", "label_method") == "no_match" and got["kind"]["conflicts"] == ["product_category"] and got["grey"]["conflicts"] == ["color"]


def test_ranks_chain_over_ties(spark):
    rows = [("a", s, i) for i, s in enumerate([0.9, 0.9 - 8e-7, 0.9 - 16e-7, 0.5])]
    df = ranking.numbered(spark.createDataFrame(rows, "k string, score double, code int"), ["k"], "score", ["code"])
    assert [r["rank"] for r in ranking.island_rank(df, ["k"], "score").orderBy("ordinal").collect()] == [1, 1, 1, 4]


def test_match_orders(spark, store):
    record = dict.fromkeys(FORMAL_SCHEMA.names[:-1], "") | {"物料名称": "X 被套", "规格": "230*200cm", "颜色": "漂白色", "面料": "贡缎/T300/100C", "面料-涤棉成分": "100C", "款式": "无飞边口袋无系带式", "加标方式": "客标", "尺寸类型": "洗涤尺寸"}
    bare = record | {"规格": "", "颜色": "", "面料": "", "面料-涤棉成分": "", "款式": "", "加标方式": "", "尺寸类型": ""}
    rows = [(1, (*record.values(), 0.0)), (2, (*bare.values(), 0.0)), (3, (*(record | {"规格": "10*10cm"}).values(), 0.0))]
    records = spark.createDataFrame(rows, T.StructType([T.StructField("order_id", T.LongType()), T.StructField("record", FORMAL_SCHEMA)]))
    queries = match.order_queries(records)
    first = {r.order_id: r for r in queries.collect()}
    assert first[1].query_text.startswith("品类：被套；规格：230*200cm；颜色：漂白色；面料：贡缎/T300/100C；面料品类：贡缎；密度：T300；成分：C100")
    unit = np.eye(4)
    codes = {"M1": 0, "M2": 0, "M3": 1, "M5": 2}
    vectors = spark.createDataFrame([(c, [float(v) for v in unit[k]]) for c, k in codes.items()], "material_code string, vector array<float>")
    asked = spark.createDataFrame([(i, [float(v) for v in unit[0]]) for i in (1, 2, 3)], "order_id long, vector array<float>")
    found = match.match_orders(queries, store, asked, vectors)
    top = [(r.order_id, r["rank"], r.material_code, r.match_score) for r in found.candidates.orderBy("order_id", "ordinal").collect()]
    assert [t[:3] for t in top if t[0] == 1] == [(1, 1, "M1"), (1, 2, "M2"), (1, 3, "M5")]
    decisions = {r.order_id: r for r in found.decisions.collect()}
    assert decisions[1].decision == "unique_best_candidate" and decisions[1].removed == 1 and decisions[2].decision == "insufficient_evidence"
    assert {r.material_code for r in found.candidates.filter("order_id = 3").collect()} == {"M5"}
    conflicts = {(r.order_id, r.field): r.n for r in found.conflicts.collect()}
    assert conflicts[1, "composition"] == 1 and conflicts[None, "spec"] == 3
    totals = match.summarized(found)
    assert sum(r.orders for r in totals["decisions"].collect()) == 3 and totals["averages"].first().union_candidates == 4
    assert {r.field for r in totals["field_statuses"].collect()} == set(scoring.COMPARED)


def test_equal_documents_are_an_ambiguous_tie(spark, store):
    twice = store.filter("material_code in ('M1')").unionByName(store.filter("material_code = 'M1'").withColumn("material_code", F.lit("M9")))
    vectors = spark.createDataFrame([("M1", [1.0, 0.0]), ("M9", [1.0, 0.0])], "material_code string, vector array<float>")
    queries = twice.filter("material_code = 'M1'").select(F.lit(1).cast("long").alias("order_id"), *scoring.COMPARED, "fabric_category")
    found = match.match_orders(queries, twice, spark.createDataFrame([(1, [1.0, 0.0])], "order_id long, vector array<float>"), vectors)
    row = found.candidates.orderBy("ordinal").collect()
    assert [r["rank"] for r in row] == [1, 1] and row[0].duplicate_material_codes == ["M1", "M9"] and row[0].differing_fields == []
    assert found.decisions.first().decision == "ambiguous_tie"
