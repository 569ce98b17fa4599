"""Each operator's query against a plain version, over null, empty, long, tied, repeated and clashing rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weftspark.llm import audio, bpe, decontaminate, language, lines, quality, queries, sampling, sharding, simhash, substrings, toxicity
from weftspark.llm.rows import PRIVATE


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_substrings_equal_brute_force(spark, folder, rows, monkeypatch):
    short = [r for r in pairs(rows) if len(r[1] or "") <= 3000]  # the plain version is quadratic
    df = spark.createDataFrame(short, "doc_id long, text string")
    want = ordered(brute.substrings(short))

    def got():
        out = substrings.remove_repeats(df).collect()
        return ordered((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out)

    assert got() == want
    for name, value in (("GROUP_BYTES", 1000), ("GROUP_BYTES_MOST", 1000), ("BUCKET_ANCHORS", 20), ("RANGE_BYTES", 1500), ("SAMPLED_DOCUMENTS", 10), ("SMALL", 2)):
        monkeypatch.setattr(substrings, name, value)
    assert got() == want  # many groups, hash buckets and ranges
    for name, value in (("DIRECT_BUCKETS", 4), ("COARSE_BUCKETS", 5), ("HOT_GROUPS", 2)):
        monkeypatch.setattr(substrings, name, value)
    assert got() == want  # hashes dealt in two levels; frequent anchors string by string
    whole = queries.op2_substrings(spark, folder).collect()
    assert len(whole) == len(rows) and {r.doc_id: r.n_removed for r in whole}[108] == 0


def test_substrings_of_runs_and_hot_passages(spark, monkeypatch):
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    gram, passage = letters(30), letters(90)
    texts = ["a" * 700, "a" * 300 + letters(80), letters(60) + "a" * 120 + "b" * 200, "ab" * 200, letters(9) + "ab" * 90 + letters(70)]
    texts += [letters(40) + gram + letters(40) for _ in range(12)]  # one gram in ever different surroundings
    texts += [letters(25) + passage + letters(20) + passage for _ in range(6)]
    data = list(enumerate(texts)) + [(3, texts[1]), (90, texts[0]), (91, texts[0])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = ordered(brute.substrings(data))
    for settings in ({}, {"GROUP_BYTES": 400, "GROUP_BYTES_MOST": 400, "RANGE_BYTES": 600, "BUCKET_ANCHORS": 10}, {"HOT_GROUPS": 1}):
        for name, value in settings.items():
            monkeypatch.setattr(substrings, name, value)
        out = substrings.remove_repeats(df).collect()
        assert ordered((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out) == want
    raw = np.frombuffer(b"a" * 5000, np.uint8)
    one, _ = substrings._once(substrings._cut_out(1, 0, raw, substrings.anchors(raw)[0]))
    assert len(one) < 100 and one["multi"].any()  # a run is one suffix, but for its ends


def test_sql_of_the_queries(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    sql = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert set(queries.ORACLE_SQL) == {"op2_substrings", "op6_decontaminate", "op7_lines"}
    for name, text in queries.ORACLE_SQL.items():
        want = sql.execute(text)
        columns = [c[0] for c in want.description]
        got = ordered(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect())
        assert got == ordered(want.fetchall()), name


@pytest.mark.parametrize("small", [1, 64])
def test_multikey_sort_orders_and_groups(monkeypatch, small):
    monkeypatch.setattr(substrings, "SMALL", small)
    strings = np.random.default_rng(0).integers(0, 3, (400, 20)).astype(np.uint8)
    order, classes = substrings.multikey_sort(substrings._tokens(strings))
    ranked = [bytes(strings[i]) for i in order]
    assert ranked == sorted(ranked)
    assert [a == b for a, b in zip(classes[1:], classes, strict=False)] == [a == b for a, b in zip(ranked[1:], ranked, strict=False)]


def test_every_string_has_an_anchor():
    raw = np.random.default_rng(1).integers(97, 100, 600).astype(np.uint8)
    at, _ = substrings.anchors(raw)
    assert all(((at >= i) & (at <= i + substrings.REACH)).any() for i in range(600 - substrings.LENGTH + 1))


def test_line_dedup_equals_brute_force(spark, folder, rows, docs):
    want = ordered(brute.line_dedup(pairs(rows)))
    take = lambda df: ordered((r["doc_id"], r[f"{PRIVATE}n_lines"], r[f"{PRIVATE}n_dropped"], r[f"{PRIVATE}kept"]) for r in df.collect())
    assert sum(w[2] for w in want) > 0
    assert take(lines.dedup_lines(docs)) == want
    assert take(lines.dedup_lines(docs, broadcast_rows=-1)) == want  # the joined way
    assert take(lines.dedup_lines(docs, max_bits=1 << 18)) == want
    got = queries.op7_lines(spark, folder).collect()
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == ordered((d, n, k, brute.sha(t)) for d, n, k, t in want)


def test_decontamination_equals_brute_force(spark, folder, rows, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = ordered(brute.decontaminate(pairs(rows), items))
    got = queries.op6_decontaminate(spark, folder).collect()
    assert ordered(tuple(r) for r in got) == want and sum(w[5] for w in want) > 1
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    several = decontaminate.decontaminate(docs, benchmark, windows_per_scan=40)
    assert ordered((r["doc_id"], len(r[f"{PRIVATE}items"])) for r in several.collect()) == ordered((w[0], w[3]) for w in want)
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).filter(F.size(f"{PRIVATE}spans") > 0).count() == 0


def test_wu_manber_finds_overlapping_and_short_patterns():
    found = decontaminate.WuManber([b"aa", b"abcabcabcabc", b"bcab"]).search(b"aaa abcabcabcabcabc")
    assert sorted(found) == [(0, b"aa"), (1, b"aa"), (4, b"abcabcabcabc"), (5, b"bcab"), (7, b"abcabcabcabc"), (8, b"bcab"), (11, b"bcab"), (14, b"bcab")]


@pytest.mark.parametrize("hot_list", [simhash.HOT_LIST, 2])
def test_simhash_equals_brute_force(docs, rows, hot_list):
    got = simhash.near_duplicates(docs, hot_list=hot_list).collect()
    want = ordered(brute.simhash(pairs(rows)))
    assert ordered((r.doc_id, format(r.fingerprint % 2**64, "016x"), r.component_id) for r in got) == want


@pytest.mark.parametrize(("hot_list", "pairwise"), [(2000, 4000), (3, 4000), (3, 5)])
def test_links_connect_what_is_within_three_bits(spark, monkeypatch, hot_list, pairwise):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    centre = int(rng.integers(0, 2**63))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 7), replace=False)) for _ in range(150)} | {int(v) for v in rng.integers(0, 2**63, 150)}
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, hot_list)).collect()}
    group = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {v: new if g == old else g for v, g in group.items()}
    parts = lambda g: sorted(sorted(v for v in values if g(v) == root) for root in {g(v) for v in values})
    assert parts(lambda v: found.get(v, v)) == parts(group.get)


def test_bpe_equals_the_library_and_decodes(spark, folder, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for doc, text in pairs(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert ordered(tuple(r) for r in queries.op10_bpe(spark, folder).collect()) == ordered(want)


def test_bpe_encoder_on_awkward_words():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    own = bpe.PairIndexEncoder(queries.tokenizer_path())
    for text in ("aaaaaaaaaaaaab", "\x00a\x1cb\x85c", "İstanbul ẞ", "🙂🙂 é é", "'s't're 12.5e!!", "<|startoftext|>x<|endoftext", "ΣΑΣ Σ"):
        ids = [i for w in own.words(text) for i in ([own.special[w[1:]]] if w[0] == "\0" and w[1:] in own.special else own.encode_words([w])[0])]
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_language_of_held_out_documents(spark, folder, docs, none, rows):
    got = {r.doc_id: r for r in queries.op3_language(spark, folder).collect() if r.doc_id is not None and r.doc_id < 100 and r.doc_id % 5 and r.doc_id % 7}
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[d] for d, r in got.items()) and any(r.held_out for r in got.values())
    model = language.fit(docs, F.col("doc_id") < 40)
    odd = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert [odd[d][f"{PRIVATE}lang_pred"] for d in (103, 104, 105)] == ["und"] * 3 and odd[103][f"{PRIVATE}lang_score"] == 0
    assert language.fit(none, F.lit(True)).languages == ()
    assert language.identify(docs.limit(3), language.fit(none, F.lit(True))).filter(f"{PRIVATE}lang_pred <> 'und'").count() == 0


def test_mixture_finds_both_languages(docs, rows):
    model = language.fit(docs, F.col("doc_id") < 40)
    english, german = (" ".join(r[1] for r in rows[:40] if r[2] == k) for k in ("en", "de"))
    counts = next(language._documents(__import__("pyarrow").array([english[:3000] + " " + german[:3000]])))[1]
    which, shares = language.infer(counts, model.likelihood, np.log(model.likelihood))
    assert {model.languages[k] for k in which} == {"en", "de"} and abs(shares.sum() - 1) < 1e-6 and shares.min() > 0.3


def make(rng, n, word, share):
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 3)) for _ in range(200)]
    out = []
    for i in range(n):
        words = [str(w) for w in rng.choice(vocabulary, 80)]
        label = int(i % 2)
        if label:
            for at in rng.choice(80, max(1, int(share * 80)), replace=False):
                words[at] = word
        out.append((" ".join(words).encode(), label))
    return out


def test_toxicity_separates_held_out_texts():
    rng = np.random.default_rng(2)
    model = toxicity.fit(make(rng, 300, "grumblesnark", 0.08))
    gains = model.gains()
    scores = [(gains.score(t.decode()), y) for t, y in make(rng, 100, "grumblesnark", 0.08)]
    assert sum((s >= 0.3) == bool(y) for s, y in scores) >= 90
    assert 0 <= gains.score(None) <= 1 and gains.score("") == gains.score(None) == gains.score("...")
    assert toxicity.fit([(b"only one class", 0)]).gains().score("anything") == 0


def test_quality_network_separates_held_out_texts():
    rng = np.random.default_rng(4)
    sample = [(t.replace(b"zq!", b"zq!! "), 1 - y) for t, y in make(rng, 200, "zq!", 0.2)]
    net = quality.fit(sample)
    test = [(t.replace(b"zq!", b"zq!! "), 1 - y) for t, y in make(rng, 80, "zq!", 0.2)]
    assert sum((net.score(np.frombuffer(t, np.uint8)) >= 0.5) == bool(y) for t, y in test) >= 72
    assert 0 <= net.score(np.zeros(0, np.uint8)) <= 1


def test_quality_reads_whole_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    net = quality.fit(make(rng, 40, "qq", 0.1))
    raw = rng.integers(97, 123, 5000).astype(np.uint8)
    whole, _ = net.responses(raw)
    monkeypatch.setattr(quality, "BLOCK", 160)
    assert np.allclose(net.responses(raw)[0], whole, atol=1e-4)


def test_score_queries_run_on_awkward_rows(spark, folder, rows):
    for name, column in (("op1_toxicity", "toxic"), ("op5_quality", "quality")):
        got = queries.QUERIES[name](spark, folder).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got), column
    modulus = {r.doc_id: r.held_out for r in queries.op1_toxicity(spark, folder).collect()}
    assert all(modulus[r[0]] == brute.held_out(r[0], 4, 2) for r in rows)


def test_sample_is_bounded_and_leaves_out_held_out(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    sample, counts = sampling.labelled_sample(docs, labels, "quality", 5, 0, 4)
    assert [sum(y == k for _, y in sample) for k in (0, 1)] == [4, 4] and counts[0] > 4
    texts = {r.text: r.doc_id for r in docs.collect()}
    assert not any(brute.held_out(texts[t.decode()], 5, 0) for t, _ in sample)


def test_sharding_law_and_slots(spark, folder, docs, rows):
    got = queries.op4_sharding(spark, folder).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    small = sharding.assign(docs, sharding.tree_of(24), bucket_rows=1).collect()
    assert {(r.doc_id, r.shard) for r in small} == {(r.doc_id, r.shard) for r in got}
    assert len({(r.shard, r.slot) for r in small}) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[103].size, by_id[103].text_crc32) == (8, 0)
    assert by_id[109].text_crc32 == __import__("zlib").crc32([r[1] for r in rows if r[0] == 109][0].encode())


def test_sharding_moves_only_into_the_new_shard_and_keeps_weights(spark):
    many = spark.range(40000).withColumnRenamed("id", "doc_id")
    for n in (1, 5, 8, 13, 24):
        tree = sharding.tree_of(n)
        moved = many.select(sharding.place(F.col("doc_id"), tree).alias("a"), sharding.place(F.col("doc_id"), tree.grown()).alias("b")).groupBy("a", "b").count().collect()
        assert {r.b for r in moved if r.a != r.b} == {n}
    sizes = [r["count"] for r in many.groupBy(sharding.place(F.col("doc_id"), sharding.tree_of(24))).count().collect()]
    assert len(sizes) == 24 and max(abs(s - 40000 / 24) for s in sizes) < 250


def test_sharding_confines_movement_to_the_changed_subtree(spark):
    tree = sharding.tree_of(16)
    heavier = sharding.Tree((tree.regions[0], (tree.regions[1][0], tuple((s, w * (3 if s == 12 else 1)) for s, w in tree.regions[1][1]))))
    moved = spark.range(20000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b")).filter("a <> b").groupBy("a", "b").count().collect()
    assert moved and all(r.b >= 8 for r in moved) and not [r for r in moved if r.a < 8 and r.b < 8] and not [r for r in moved if 8 <= r.a < 12 and r.b < 12]


def test_sharding_equals_a_plain_tree_and_grows_by_one(spark):
    ids = list(range(300)) + [-5, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.s for r in df.select("doc_id", sharding.place(F.col("doc_id"), sharding.tree_of(24)).alias("s")).collect()}
    assert got == {i: brute.shard(i, [(n // 8, n % 8 // 4, n, 1.0) for n in range(24)]) for i in ids}
    many = spark.range(3000).select("id", *[sharding.place(F.col("id"), sharding.tree_of(n)).alias(f"s{n}") for n in range(1, 41)])
    moved = many.agg(*[F.count_if((F.col(f"s{n + 1}") != F.col(f"s{n}")) & (F.col(f"s{n + 1}") != n)).alias(f"m{n}") for n in range(1, 40)]).first()
    assert set(moved) == {0} and all(sharding.tree_of(n + 1) == sharding.tree_of(n).grown() for n in range(41))


def test_slots_of_one_id_that_repeats(spark):
    out = sharding.assign(spark.range(2000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("x").alias("text")), sharding.tree_of(3), bucket_rows=20).collect()
    assert len({r.shard for r in out}) == 1 and sorted(r.slot for r in out) == list(range(2000))


def test_toxicity_equals_a_plain_version():
    rng = np.random.default_rng(2)
    model = toxicity.fit(make(rng, 120, "grumblesnark", 0.08))
    gains = model.gains()
    for text, _ in make(rng, 12, "grumblesnark", 0.08) + [(b"", 0), (b"Just one, word! grumblesnark", 1)]:
        assert list(gains.of(text.decode())) == brute.gains(model, text.decode())
        assert abs(gains.score(text.decode()) - brute.toxicity(model, text.decode())) < 1e-9


def test_quality_equals_a_plain_convolution():
    rng = np.random.default_rng(6)
    net = quality.fit(make(rng, 30, "qq", 0.1))
    for n in (0, 1, 31, 32, 33, 48, 200):
        raw = rng.integers(97, 123, n).astype(np.uint8)
        assert abs(net.score(raw) - brute.network(net, raw.tobytes())) < 1e-4


def test_mixture_equals_plain_expectation_maximisation(docs):
    model = language.fit(docs, F.col("doc_id") < 40)
    for text in ("the and ing, er!", "sch ein 5 ung ich the there", "einung"):
        counts = next(language._documents(__import__("pyarrow").array([text])))[1]
        at = np.flatnonzero(counts)
        share, likely = language.mixture(counts[at].astype(float), model.likelihood[at])
        want, value = brute.trigram_shares(text, model.likelihood, language.ROUNDS, language.BUCKET_BITS)
        assert np.allclose(share, want, atol=1e-9) and abs(likely - value) < 1e-6


def test_tokenizer_files_with_other_steps_are_refused():
    with pytest.raises(bpe.UnsupportedTokenizer, match="normalizer"):
        bpe.PairIndexEncoder(queries.tokenizer_path("byte_bpe_50k.json"))


def pcm(samples):
    return (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()


def test_audio_aligns_a_shifted_noisy_recording(spark):
    rng = np.random.default_rng(8)
    tune = audio.melody(list(rng.normal(0, 1 / 8, 64)))
    other = audio.melody(list(rng.normal(0, 1 / 8, 64)))
    shift = 10 * audio.HOP
    noisy = tune[shift:] + rng.normal(0, 0.01, len(tune) - shift).astype(np.float32)
    data = [(0, pcm(tune)), (1, pcm(noisy)), (2, pcm(other)), (3, pcm(tune)), (4, None), (5, b""), (6, b"\0" * 40000), (50, pcm(other)), (None, pcm(other))]
    df = spark.createDataFrame(data, "rec long, media binary").withColumn("prints", F.lit("clash"))
    got = {r.id: r for r in audio.align(audio.fingerprints(df, "media", "rec")).collect()}
    assert len(got) == len(data) and got[3].class_id == 0 and got[4].class_id == got[5].class_id == 4
    assert (got[0].n_links, got[0].match_id, got[0].shift) == (1, 1, 10) and got[0].bit_error < 0.2
    assert got[50].class_id == 2 and got[50].n_links == 0 and got[2].n_links is None


def every_offset(a, b, votes):
    """The plain version: bit error and shift of the best of all offsets."""
    best = None
    for s in range(audio.LEAST_OVERLAP - len(b), len(a) - audio.LEAST_OVERLAP + 1):
        differ = [(int(x) ^ int(y)).bit_count() for x, y in zip(a[max(s, 0) :], b[max(-s, 0) :], strict=False)]
        error = sum(differ) / (32.0 * len(differ))
        runs = sum(sum(differ[i : i + audio.RUN]) <= audio.VOTE_ERRORS * 32 * audio.RUN for i in range(len(differ) - audio.RUN + 1))
        if error <= audio.MOST_ERRORS and runs >= votes:
            best = min(best or (2.0,), (error, abs(s), -s))
    return best and (best[0], -best[2])


def test_audio_links_moderate_bit_errors(spark):
    rng = np.random.default_rng(4)
    media = []
    for i in range(12):  # a tune, and the same with one note in four moved by a semitone; of unequal lengths
        values = rng.normal(0, 1 / 8, 64 - i % 3 * 7)
        steps = np.clip(np.floor(values * 24) + 6, 0, 11).astype(int)
        steps[i % 4 :: 4] = (steps[i % 4 :: 4] + rng.choice([-1, 1], len(steps[i % 4 :: 4]))) % 12
        media += [(100 * i, pcm(audio.melody(list(values * 24 / 3 / len(values) ** 0.5)))), (100 * i + 1, pcm(audio._NOTES[steps].ravel()))]
    prints = {i: audio.packed(audio.chroma(audio.pcm16(m))).view(np.uint32) for i, m in media}
    df = audio.fingerprints(spark.createDataFrame(media, "rec long, media binary"), "media", "rec")
    linked = audio.align(df).collect()
    assert all(r.n_links >= 1 for r in linked if r.id % 100 == 0)
    for votes, rows in ((audio.LEAST_VOTES, linked), (0, audio.align(df, least_votes=0).collect())):
        got = {r.id: r for r in rows}
        for q in (i for i in prints if i % 100 == 0):
            want = {i: best for i, p in prints.items() if i != q and (best := every_offset(prints[q], p, votes))}
            error, match, shift = min((e, i, s) for i, (e, s) in want.items())
            assert q + 1 in want and (got[q].n_links, got[q].match_id, got[q].shift, got[q].bit_error) == (len(want), match, shift, error)


def test_audio_finds_recordings_cut_between_frames(spark):
    rng = np.random.default_rng(12)
    media, tunes = [], 8
    settings = [(cut, noise) for cut in (0, 64, 128, 192) for noise in (0.0, 0.1, 0.2)]
    for t in range(tunes):
        tune = audio.melody(list(rng.normal(0, 1 / 8, 64)))
        media.append((1000 * t, pcm(tune / 2)))
        for k, (cut, noise) in enumerate(settings):
            part = tune[10 * audio.HOP + cut :]
            media.append((1000 * t + k + 1, pcm((part + rng.normal(0, noise, len(part))) / 2)))
    prints = audio.fingerprints(spark.createDataFrame(media, "rec long, media binary"), "media", "rec")
    got = audio.align(prints).collect()
    found = {r.id: r.n_links for r in got if r.id % 1000 == 0}
    print("recall", sum(found.values()) / (tunes * len(settings)))
    assert sum(found.values()) >= 0.9 * tunes * len(settings) and all(abs(r.shift - 10) <= 1 for r in got if r.id % 1000 == 0)


def test_all_filters_equal_plain_sums():
    frames = np.random.default_rng(3).random((17, 12)).astype(np.float32)
    wide = np.concatenate([frames, frames[:, :6]], axis=1).astype(float)
    got = audio.packed(frames)
    for start in range(len(got)):
        block = wide[start : start + 8]
        for i, (kind, low, height) in enumerate(audio._filters()):
            band, above = block[:, low : low + height], block[:, low + height : low + 2 * height]
            if kind == 0:
                x, y = band.sum(), above.sum()
            elif kind == 1:
                x, y = band[:4].sum(), band[4:].sum()
            elif kind == 2:
                x, y = band[:4].sum() + above[4:].sum(), band[4:].sum() + above[:4].sum()
            else:
                x, y = 2 * band[2:6].sum(), band.sum()
            level = int(np.searchsorted(audio.CUTS, np.log((0.05 + x) / (0.05 + y))))
            assert got[start] >> np.uint32(30 - 2 * i) & 3 == audio.GRAY[level]


def test_audio_aligns_repeated_passages_and_silence(spark):
    rng = np.random.default_rng(6)
    x, y, z = (audio.melody(list(rng.normal(0, 1 / n**0.5, n))) for n in (30, 30, 18))
    media = [(0, pcm(np.concatenate([x, y, x, z]))), (1, pcm(np.concatenate([x, z]))), (50, b"\0" * 40000), (51, b"\0" * 60000)]
    df = audio.fingerprints(spark.createDataFrame(media, "rec long, media binary"), "media", "rec")
    got = {r.id: r for r in audio.align(df).collect()}
    assert (got[0].match_id, got[0].shift, got[0].n_links) == (1, 120, 1) and got[0].bit_error < 0.001
    assert (got[50].match_id, got[50].shift, got[50].bit_error, got[50].n_links) == (51, 0, 0.0, 1)


def test_toxicity_windows_without_spaces():
    phrase = "".join(chr(0x4E00 + 37 * i) for i in range(12))
    model = toxicity.ToxicityModel(phrase.encode() * 3, b"")
    clean = "".join(chr(0x3041 + i) for i in np.random.default_rng(3).integers(0, 80, 9000))
    for text in (clean + phrase, clean):
        cut = toxicity.windows(toxicity.fold(text))
        assert max(map(len, cut)) <= toxicity.LONGEST_BYTES + 2 and "".join(w[1:-1].decode() for w in cut) == text
    assert model.gains().of(clean + phrase).max() > 10 > model.gains().of(clean).max()
    assert toxicity.windows(b"word " * 12 + b"x" * 30) == [b" " + w + b" " for w in (b"word " * 4 + b"word", b"word " * 4 + b"word", b"word word " + b"x" * 30)]


def test_audio_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(v) for v in rng.normal(0, 1 / 8, 64)], 0) for i in range(60)]
    vectors += [(60, vectors[50][1], 1), (61, None, 1), (62, [], 1), (63, [None] * 64, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op8_audio(spark, str(tmp_path)).collect()}
    want = audio.packed(audio.chroma(audio.melody(list(np.array(vectors[7][1], np.float32).astype(float))))).view(np.int32)
    assert got[7].prints_sha256 == brute.sha(",".join(map(str, want.tolist()))) and got[7].n_prints == len(want)
    assert got[60].class_id == 50 and got[61].n_prints == 0 and got[0].n_links == 0


def test_integral_image_filters_equal_plain_sums():
    frames = np.random.default_rng(1).random((20, 12)).astype(np.float32)
    wide = np.concatenate([frames, frames[:, :6]], axis=1)
    got = audio.packed(frames)
    kind, low, height = audio._filters()[0]
    x, y = wide[3:11, low : low + height].sum(), wide[3:11, low + height : low + 2 * height].sum()
    level = np.searchsorted(audio.CUTS, np.log((0.05 + x) / (0.05 + y)))
    assert kind == 0 and len(got) == 13 and got[3] >> 30 == audio.GRAY[level]


def test_operators_ignore_or_keep_clashing_columns(clashing, spark, folder, rows):
    n = len(rows)
    model = language.fit(clashing, F.col("doc_id").isNotNull())
    passing = [
        language.identify(clashing, model),
        lines.dedup_lines(clashing),
        lines.dedup_lines(clashing, broadcast_rows=-1),
        decontaminate.decontaminate(clashing, spark.read.parquet(f"{folder}/benchmark.parquet")),
        toxicity.score_toxicity(clashing, toxicity.ToxicityModel(b"", b"")),
        quality.score_quality(clashing, quality.fit([])),
    ]
    for df in passing:
        assert df.columns[: len(clashing.columns)] == clashing.columns and df.filter("g = 'clash' and keeper = 'clash'").count() == n
    for df in (simhash.near_duplicates(clashing), sharding.assign(clashing, sharding.tree_of(24)), bpe.encode(clashing, queries.tokenizer_path())):
        assert df.count() == n
    assert substrings.remove_repeats(clashing.filter("doc_id < 30")).count() == 30


def test_operators_on_empty_tables(none, spark, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    model = language.fit(none, F.lit(True))
    for df in (
        language.identify(none, model),
        lines.dedup_lines(none),
        decontaminate.decontaminate(none, benchmark),
        simhash.near_duplicates(none),
        sharding.assign(none, sharding.tree_of(24)),
        bpe.encode(none, queries.tokenizer_path()),
        substrings.remove_repeats(none),
        toxicity.score_toxicity(none, toxicity.fit([])),
        quality.score_quality(none, quality.fit([])),
        audio.align(audio.fingerprints(none.select("doc_id", F.lit(None).cast("binary").alias("media")), "media", "doc_id")),
    ):
        assert df.count() == 0
    assert sampling.labelled_sample(none, none.select("doc_id", F.lit(1).alias("toxic")), "toxic", 4, 2, 5) == ([], (0, 0))
