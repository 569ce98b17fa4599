"""Run state, streams, revisions, publications, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_match import HEADER, ROWS
from tests.test_parse import INVOICE
from tests.workbooks import workbook
from weftspark.__main__ import run
from weftspark.functions.encoder import assert_valid, encode_texts, hash_encoder
from weftspark.operators import resolution, revisions, states
from weftspark.sources import sinks
from weftspark.streaming import runs

EVENTS = [
    ("a", "pending", "2026-01-01 00:00:00", ""), ("a", "in_progress", "2026-01-01 00:00:01", ""), ("a", "validated", "2026-01-01 00:00:02", "x"), ("a", "in_progress", "2026-01-01 00:00:03", ""),
    ("a", "validated", "2026-01-01 00:00:04", "x"), ("a", "validated", "2026-01-01 00:00:05", "other"), ("b", "in_progress", "2026-01-01 00:00:00", ""), ("b", "pending", "2026-01-01 00:00:01", ""),
    ("b", "in_progress", "2026-01-01 00:00:02", ""),
]


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"unit_id": u, "state": s, "at": at, "attempt": i, "payload": p}) for i, (u, s, at, p) in enumerate(rows)))


def test_state_machine_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "1.json", EVENTS)
    step = lambda: runs.drain(runs.unit_states(runs.event_stream(spark, str(tmp_path / "in")), watermark="1 second"), str(tmp_path / "out"), str(tmp_path / "ck"))
    step()
    got = {(r.unit_id, r.state, r.previous, r.outcome): r.attempt for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("a", "validated", "in_progress", "accepted")] == 1 and ("a", "in_progress", "validated", "refused") in got and ("a", "validated", "validated", "refused") in got
    assert ("b", "in_progress", "", "refused") in got and got[("b", "in_progress", "pending", "accepted")] == 1
    put(tmp_path / "in", "2.json", [("c", "pending", "2026-01-01 02:00:00", "")])
    step()
    put(tmp_path / "in", "3.json", [("c", "in_progress", "2026-01-01 02:00:01", "")])
    step()
    got = {(r.unit_id, r.state, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("b", "interrupted", "lease_expired") in got and ("c", "in_progress", "accepted") in got


def test_claims_and_activity_as_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "1.json", EVENTS)
    stream = runs.event_stream(spark, str(tmp_path / "in")).select(F.col("unit_id").alias("client_key"), F.lit("b").alias("business_key"), F.lit("c").alias("cache_key"), "at")
    runs.drain(runs.claims(stream), str(tmp_path / "claims"), str(tmp_path / "ck1"))
    rows = spark.read.parquet(str(tmp_path / "claims")).collect()
    assert sorted(r.client_key for r in rows) == ["a", "b"] and len({r.execution_id for r in rows}) == 2
    put(tmp_path / "in", "2.json", [("z", "pending", "2026-01-02 00:00:00", "")])
    runs.drain(runs.activity(runs.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "act"), str(tmp_path / "ck2"))
    got = {r.state: r.events for r in spark.read.parquet(str(tmp_path / "act")).collect()}
    assert got == {"pending": 2, "in_progress": 4, "validated": 3}


def test_incoming_workbooks_are_processed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(workbook([("pi", [["x"]], {})]))
    (tmp_path / "in" / "b.txt").write_text("no")
    seen = []
    for _ in range(2):
        runs.run_incoming(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r.path[-6:] for r in df.collect()), str(tmp_path / "ck"))
    assert seen == ["a.xlsx"]


def test_transitions_claims_lineage_and_gaps_as_tables(spark):
    df = spark.createDataFrame([(u, s, i) for i, (u, s, _, _) in enumerate(EVENTS)], "u string, s string, i int")
    allowed = {k: v for k, v in runs.TRANSITIONS.items() if k}
    got = states.check_transitions(df, ["u"], ["i"], "s", allowed, runs.TRANSITIONS[""]).orderBy("i").collect()
    assert [r.legal for r in got] == [True, True, True, False, True, True, False, False, True]
    asked = spark.createDataFrame([("k", "b", 1), ("k", "b", 2), ("x", "b", 1), ("x", "c", 2)], "client string, business string, i int")
    assert {r.client: (r.business, r.requests, r.conflict) for r in states.claims(asked, "client", ["business"], ["i"]).collect()} == {"k": ("b", 2, False), "x": ("b", 2, True)}
    line = spark.createDataFrame([("a", 0, "r0", None), ("a", 1, "r1", "r0"), ("b", 0, "r0", None), ("b", 2, "r2", "r0"), ("c", 0, "r0", None), ("c", 1, "r1", "zz")], "h string, n int, r string, p string")
    assert {r.h: r.contiguous for r in states.check_lineage(line, ["h"], "n", "r", "p").collect()} == {"a": True, "b": False, "c": False}
    assert sorted(r.n for r in states.number_gaps(line.filter("h = 'b'"), "n").collect()) == [1]


def test_revisions(spark):
    histories = spark.createDataFrame([("h",)], "history string")
    base = revisions.start(spark, histories)
    zero = base.first().revision
    ask = lambda *rows: spark.createDataFrame([("h", *r) for r in rows], "history string, expected string, record_id string, field string, value string, action string")
    new, refused = revisions.append(base, ask((zero, "r", "数量", " 05.0 ", "enter_value"), (zero, "r", "编码", "x", "enter_value"), ("old", "r", "颜色", "x", "enter_value"), (zero, "r", "颜色", "x", "write")))
    assert [(r.number, r.value, r.parent) for r in new.collect()] == [(1, "5", zero)]
    assert sorted(r.reason for r in refused.collect()) == ["field_not_editable", "history_moved_on", "unknown_action"]
    history = base.unionByName(new).cache()
    again, refused = revisions.append(history, ask((zero, "r", "数量", " 05.0 ", "enter_value")))
    assert again.count() == 0 and refused.first().reason == "already_applied"
    rival, refused = revisions.append(base, ask((zero, "r", "颜色", "a", "confirm"), (zero, "r", "颜色", "b", "confirm")))
    assert rival.count() == 1 and refused.first().reason == "history_moved_on"
    assert states.check_lineage(history, ["history"], "number", "revision", "parent").first().contiguous
    decisions = spark.createDataFrame([("r", f, "v", "ai_selected", True, "high") for f in resolution.BUSINESS_FIELDS], "record_id string, field string, value string, status string, review_required boolean, severity string")
    now = {r.field: r for r in revisions.current_values(decisions, history).collect()}
    assert (now["数量"].value, now["数量"].status, now["数量"].review_required) == ("5", "revised", False) and now["颜色"].value == "v"
    assert revisions.review_summary(revisions.current_values(decisions, history)).first().high == 16


def test_publication_is_all_or_nothing_and_content_addressed(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.write_pair(spark, {"x": df, "y": df}, f"{tmp_path}/out")
    with pytest.raises(sinks.PublicationError):
        sinks.write_pair(spark, {"x": df}, f"{tmp_path}/out")
    sinks.write_pair(spark, {"x": df.union(df)}, f"{tmp_path}/out", overwrite=True)
    assert spark.read.json(f"{tmp_path}/out/x").count() == 2 and not (tmp_path / "out" / "y").exists() and {p.name for p in tmp_path.iterdir()} == {"out"}
    first = sinks.publish_bundle(spark, f"{tmp_path}/root", "k", {"a": {"z": 1, "b": "é"}})
    assert not first["reused"] and sinks.publish_bundle(spark, f"{tmp_path}/root", "k", {"a": {"b": "é", "z": 1}})["reused"]
    with pytest.raises(sinks.PublicationError):
        sinks.publish_bundle(spark, f"{tmp_path}/root", "k", {"a": 2})
    sinks.publish_bundle(spark, f"{tmp_path}/root", "k2", {"a": 2}, switch_current=False)
    assert sinks.current_bundle(spark, f"{tmp_path}/root") == "k" and (tmp_path / "root/bundles/k/a.json").read_text() == '{"b":"é","z":1}'
    seen = sinks.unchanged(spark, f"{tmp_path}/root/bundles/k")
    (tmp_path / "root/bundles/k/.a.json.crc").unlink()
    (tmp_path / "root/bundles/k/a.json").write_text("{}")
    with pytest.raises(sinks.PublicationError):
        sinks.unchanged(spark, f"{tmp_path}/root/bundles/k", seen)


def test_vectors_are_encoded_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id long, text string").fillna("")
    calls = spark.sparkContext.accumulator(0)

    def encode(df):
        calls.add(df.count())
        return encode_texts(df, hash_encoder)

    assert sinks.encode_missing(texts, encode, f"{tmp_path}/v", "m").count() == 3
    more = texts.union(spark.createDataFrame([(4, "four")], texts.schema)).withColumn("text", F.when(F.col("id") == 2, "zwei").otherwise(F.col("text")))
    out = sinks.encode_missing(more, encode, f"{tmp_path}/v", "m")
    assert calls.value == 5 and out.count() == 4 and assert_valid(out, 64).count() == 4
    with pytest.raises(Exception, match="invalid vector"):
        assert_valid(out.withColumn("vector", F.array(F.lit(1.0).cast("float"))), 64).collect()


def test_command_line(spark, tmp_path):
    from argparse import Namespace

    (tmp_path / "books").mkdir()
    (tmp_path / "books/a.xlsx").write_bytes(workbook([("pi", INVOICE, {"merges": ["B4:D4"]})]))
    (tmp_path / "m.csv").write_text("\n".join([HEADER, *ROWS]), encoding="utf-8")
    assert run(spark, Namespace(command="parse", workbooks=f"{tmp_path}/books", output=f"{tmp_path}/records", overwrite=False)) == {"records": 3}
    assert run(spark, Namespace(command="build", master_csv=f"{tmp_path}/m.csv", output=f"{tmp_path}/store", overwrite=False))["materials"] == 6
    assert run(spark, Namespace(command="build-index", store=f"{tmp_path}/store", output=f"{tmp_path}/index", overwrite=False)) == {"all": 6, "category": 4}
    top = run(spark, Namespace(command="search-index", index=f"{tmp_path}/index", query="品类:被套", scope="all", top_k=3, encoder=None))["found"]
    assert len(top) == 3 and top[0]["similarity"] >= top[1]["similarity"]
    found = run(spark, Namespace(command="match-orders", records=f"{tmp_path}/records", store=f"{tmp_path}/store", index=f"{tmp_path}/index", output=f"{tmp_path}/matches", overwrite=False))
    assert sum(found.values()) == 3
    made = run(spark, Namespace(command="build-review", matches=f"{tmp_path}/matches", records=f"{tmp_path}/records", store=f"{tmp_path}/store", output=f"{tmp_path}/review", overwrite=False))
    assert made["review"] == 3 and made["materials"] == 6


def test_dictionary_commands(spark, tmp_path, books):
    from argparse import Namespace

    (tmp_path / "books").mkdir()
    (tmp_path / "books/a.xlsx").write_bytes(workbook([("pi", INVOICE, {"merges": ["B4:D4"]})]))
    run(spark, Namespace(command="parse", workbooks=f"{tmp_path}/books", output=f"{tmp_path}/records", overwrite=False))
    own = dict(rules=books[0][0], styles=books[0][1], rules_sha256=books[1][0], styles_sha256=books[1][1], overwrite=False)
    assert run(spark, Namespace(command="build-preview", output=f"{tmp_path}/preview", **own)) == {"rules": 35, "fabrics": 75, "styles": 105}
    totals = run(spark, Namespace(command="shadow-compare", records=f"{tmp_path}/records", output=f"{tmp_path}/shadow", **own))
    assert totals["records"] == 3 and totals["comparisons"] == 30
    actions = run(spark, Namespace(command="integration-preview", shadow=f"{tmp_path}/shadow", output=f"{tmp_path}/proposals", overwrite=False))
    assert sum(actions.values()) == 30


def test_pointers_are_replaced_in_one_step(spark, tmp_path):
    for text in ("one", "two"):
        sinks.write_text(spark, f"{tmp_path}/CURRENT", text)
        assert sinks.read_text(spark, f"{tmp_path}/CURRENT") == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["CURRENT"]


def test_encoding_goes_on_behind_what_is_committed(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string")
    done = []

    def encode(df):
        done.append(df.count())
        if len(done) == 3:
            raise RuntimeError("broken off")
        return df.withColumn("vector", F.array(F.lit(1.0)))

    with pytest.raises(RuntimeError):
        sinks.encode_missing(texts, encode, f"{tmp_path}/v", "m", chunk_rows=4)
    kept = spark.read.parquet(f"{tmp_path}/v/identity=m").count()
    assert kept == sum(done[:2]) > 0
    assert sinks.encode_missing(texts, encode, f"{tmp_path}/v", "m", chunk_rows=4).count() == 20 and sum(done[3:]) == 20 - kept


def test_leases_and_attempts(spark):
    rows = [
        ("a", "x", "acquire", "2026-01-01 00:00:00"), ("a", "y", "acquire", "2026-01-01 00:00:10"), ("a", "x", "heartbeat", "2026-01-01 00:00:20"),
        ("b", "x", "acquire", "2026-01-01 00:00:00"), ("b", "y", "acquire", "2026-01-01 00:00:40"),
        ("c", "x", "acquire", "2026-01-01 00:00:00"), ("c", "x", "release", "2026-01-01 00:00:05"),
    ]
    events = spark.createDataFrame(rows, "unit string, owner string, kind string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.unit: (r.owner, r.expired) for r in states.leases(events, "unit", "owner", "kind", "at", "2026-01-01 00:00:51").collect()}
    assert got == {"a": ("x", True), "b": ("y", False)}
    steps = spark.createDataFrame([("a", 1, "transient"), ("b", 1, "transient"), ("b", 2, "transient"), ("b", 3, "transient"), ("c", 1, "failed"), ("d", 1, "running"), ("e", 1, "transient"), ("e", 2, "succeeded")], "unit string, n int, outcome string")
    assert {r.unit: r.next_step for r in states.next_attempts(steps, ["unit"], ["n"], "outcome", 3).collect()} == {"a": "retry", "b": "failed", "c": "failed", "d": "recover", "e": "done"}
