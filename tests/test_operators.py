import pytest
from pyspark.sql import functions as F, types as T

from tessera.functions.label import map_category
from tessera.operators import quality as Q, split as S, vectors as V
from tessera.plans import builds
from tessera.sources import notes


@pytest.mark.parametrize(("n", "want"), [(5, (4, 0, 1)), (15, (12, 2, 1)), (35, (28, 4, 3)), (4999, (3999, 500, 500))])
def test_half_even_sizes(n, want):
    assert S.sizes(n, (0.8, 0.1, 0.1), half_even=True) == want


def test_floor_sizes_and_bad_fractions():
    assert S.sizes(15, (0.8, 0.1, 0.1), half_even=False) == (12, 1, 2)
    for bad in ((0.8, 0.1, 0.2), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            S.sizes(10, bad, half_even=True)


def turns(spark, n, k=4):
    return spark.range(n).select(F.concat(F.lit("seed_"), F.col("id").cast("string")).alias("seed_id"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("v"))


def test_grouped_split(spark):
    x = S.split_grouped_seeds(turns(spark, 50), "seed_id")
    assert x.count() == 200 and S.verify_no_leakage(x)
    assert {r["split"]: r["n"] for r in x.groupBy("split").agg(F.count_distinct("seed_id").alias("n")).collect()} == {"train": 40, "val": 5, "test": 5}
    with pytest.raises(ValueError):
        S.split_grouped_seeds(turns(spark, 5), "seed_id")
    assert S.split_grouped_seeds(turns(spark, 5), "seed_id", allow_empty=True).count() == 20
    with pytest.raises(ValueError):
        S.split_grouped_seeds(turns(spark, 0), "seed_id")


def test_rank_split_is_that_of_a_global_rank(spark):
    import hashlib

    x = {r["id"]: r["split"] for r in S.split_rank_rows(spark.range(777), "id").collect()}
    order = sorted(range(777), key=lambda i: hashlib.sha256(f"1337:{i}".encode()).hexdigest())
    want = {i: "train" if k < 621 else "val" if k < 698 else "test" for k, i in enumerate(order)}
    assert x == want


def test_cuts_in_large_groups(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(S, "SMALL", 1)
    monkeypatch.setattr(S, "DIGITS", 1)
    keys = spark.range(60).unionAll(spark.range(20)).select(F.col("id").alias("k"))
    h = sorted(hashlib.sha256(f"1337:{i}".encode()).hexdigest() for i in [*range(60), *range(20)])
    for a, b in ((0, 79), (33, 34), (10, 80)):
        assert S.cut_hashes(keys, "k", a, b - a) == (h[a], h[b] if b < 80 else None)


def test_expected_columns_and_fractions(spark):
    x = spark.createDataFrame([], "a int, b int, c int")
    assert Q.expect_columns(x, ["a", "c"]) and not Q.expect_columns(x, ["a", "d"]) and Q.expect_columns(x, [])
    S.check_fractions((0.8, 0.1, 0.1))
    with pytest.raises(ValueError):
        S.check_fractions((0.5, 0.1, 0.1))


def test_sets_of_splits_and_labels(spark):
    x = spark.createDataFrame([("a", "train"), ("a", "test"), ("a", "val"), ("b", "val"), ("b", "val"), ("c", "test"), ("c", "val")], "seed_id string, split string")
    got = {tuple(r) for r in S.shared_seeds(x).select("one", "other", "seed_id").collect()}
    assert got == {("train", "val", "a"), ("train", "test", "a"), ("val", "test", "a"), ("val", "test", "c")}
    a, b = (spark.createDataFrame([(v,) for v in vs], "v string") for vs in ("xy", "yz"))
    assert {tuple(r) for r in Q.set_difference(a, b, "one", "two").collect()} == {("one", "x"), ("two", "z")}


def test_ids_get_their_splits(spark):
    rows, splits = spark.range(5).withColumn("x", F.col("id")), spark.createDataFrame([(k, "train") for k in range(4)], "id bigint, split string")
    assert S.join_split_ids(rows.where("id < 4"), splits, "id").where("split = 'train'").count() == 4
    with pytest.raises(Exception, match="no split for id 4"):
        S.join_split_ids(rows, splits, "id").collect()


def test_planted_leak_is_found(spark):
    x = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "seed_id string, split string")
    assert not S.verify_no_leakage(x) and [r["seed_id"] for r in S.leaks(x).collect()] == ["a"]


def test_numbering(spark):
    # one key far off the others
    keys = [*(k * k * 7 for k in range(100)), 1 << 60]
    x = spark.createDataFrame([(k,) for k in keys], "key bigint").repartition(5)
    got = {r["key"]: r["number"] for r in S.numbered(x, "key").collect()}
    assert got == {k: n for n, k in enumerate(keys)}
    odd = S.numbered(x, "key", lambda y: y.where("key % 2 = 1"))
    assert [r["number"] for r in odd.orderBy("key").collect()] == list(range(50))
    assert S.numbered(x.limit(0), "key").count() == 0


def test_categories_and_quarantine(spark):
    x = spark.createDataFrame([(" Surgery ",), ("Surgery",), (None,), ("Letters",), ("Nope",)], "raw_category string")
    got = map_category(x).groupBy("department_code", "routing_confidence").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("SURGERY", "high"): 2, ("GEN_MED", "low"): 1, (None, None): 2}
    assert Q.quarantine_unknown(x).count() == 2
    with pytest.raises(Exception, match="unknown category"):
        map_category(x, strict=True).collect()


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        Q.audit_filter(spark.range(1))
    with pytest.raises(ValueError, match="missing"):
        notes.notes_validated(spark.range(1))


def test_losses(spark):
    x = spark.createDataFrame([([5.0, 0.0], [5.0, 0.0], 0, 0), ([0.0, 5.0], [5.0, 0.0], 1, 1)], "a array<double>, b array<double>, y int, z int")
    r = x.agg(F.avg((V.argmax(F.col("a")) == F.col("y")).cast("int")).alias("p"), F.avg((V.argmax(F.col("b")) == F.col("z")).cast("int")).alias("q"), F.avg(V.cross_entropy(F.col("a"), F.col("y"))).alias("l")).first()
    assert (r["p"], r["q"]) == (1.0, 0.5) and abs(r["l"] - 0.006715) < 1e-5
    empty = V.running_metrics(spark.createDataFrame([], "loss double, n bigint, correct bigint")).first()
    assert (empty["loss"], empty["accuracy"]) == (0.0, 0.0)


def test_vocabulary_plan_and_warm_start(spark):
    plan = V.vocab_plan(V.rule_frame(spark))
    assert plan.count() == 53
    base = spark.createDataFrame([("hai", [1.0, 2.0]), ("he", [9.0, 9.0])], "token string, vector array<double>")
    anchors = base.select(F.col("token").alias("canonical"), "vector")
    once = V.warm_start(plan, anchors, base)
    got = {r["token"]: r["vector"] for r in once.collect()}
    assert got == {"hai": [1.0, 2.0], "he": [9.0, 9.0], "hain": [1.0, 2.0], "hy": [1.0, 2.0]}
    assert Q.same_rows(V.warm_start(plan, anchors, once), once)


def test_notes_from_a_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="absent"):
        notes.read_notes(spark, f"file://{tmp_path}/absent.csv")
    (tmp_path / "bad.csv").write_text("id,text\n1,x\n")
    with pytest.raises(ValueError, match="transcription"):
        notes.read_notes(spark, f"file://{tmp_path}/bad.csv")
    rows = [("1", ' He said "no", then\nleft ', "Surgery"), ("2", None, " Letters "), ("3", "", None), ("4", "a,b\r\nc\\", "x")]
    df = spark.createDataFrame(rows, "row string, transcription string, medical_specialty string")
    notes.write_csv(df, f"file://{tmp_path}/n")
    back = notes.read_notes(spark, f"file://{tmp_path}/n")
    assert sorted(map(tuple, back.collect())) == rows and back.columns[0] == "seed_id"
    assert tuple(notes.notes_counts(back).first()) == (4, 3, 1)
    assert {r["seed_id"] for r in notes.notes_validated(back).collect()} == {"1", "3", "4"}
    declared = notes.read_notes(spark, f"file://{tmp_path}/n", schema=T.StructType([T.StructField("transcription", T.StringType()), T.StructField("row", T.IntegerType())]))
    assert [f.dataType.simpleString() for f in declared.schema] == ["string", "string", "string"]  # the id is a string under any name
    (tmp_path / "n" / "part-other.csv").write_text('row,medical_specialty,transcription\n9,x,y\n')
    with pytest.raises(Exception, match="CSV header does not conform"):
        notes.read_notes(spark, f"file://{tmp_path}/n").collect()


def test_nan_becomes_null(spark, tmp_path):
    x = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.5, None)], "k int, v double, t string")
    assert [tuple(r) for r in notes.nan_to_null(x).orderBy("k").collect()] == [(1, None, "a"), (2, 1.5, None)]
    notes.write_clean_json(x, f"file://{tmp_path}/j", spark.range(1))
    assert "NaN" not in "".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/j/records").collect())


def test_variants_are_labelled_and_perturbed_as_if_each_were_whole(spark):
    from tessera.catalogue import clinical
    from tessera.functions.ids import perturb_seed
    from tessera.functions.label import severity_cascade5
    from tessera.functions.perturb import perturb_text
    from tessera.operators.expand import expand_variants
    from tessera.sources.shared import written

    x = clinical(spark, "/root/testdata/sf0.001").select("seed_id", "text")
    for rate in (None, 0.5):
        y = written(expand_variants(x, rate, with_severity=True), "expanded")
        direct = y.select("severity", severity_cascade5(F.col("text")).alias("s"), "is_perturbed")
        assert direct.where("severity.severity <> s.severity or not severity.matched_pattern <=> s.matched_pattern").isEmpty()
        assert direct.where("severity.matched_tier <> s.matched_tier").isEmpty()
    plain = expand_variants(x, None).where("is_perturbed").select("tracking_id", perturb_text(F.col("text"), perturb_seed(F.col("tracking_id")), 0.5).alias("p"))
    want = {r["tracking_id"]: (r["p"]["text"], r["p"]["subs"]) for r in plain.collect()}
    assert {r["tracking_id"]: (r["text"], r["subs"]) for r in y.where("is_perturbed").collect()} == want


def test_manifest(spark):
    from tessera.operators import summary

    x = spark.createDataFrame([("a", 0, "train", "S1"), ("a", 1, "train", "S4"), ("b", 0, "val", None), ("c", 0, "val", "S4")], "seed_id string, v int, split string, s string")
    r = summary.manifest(x, {"s": "severities", "split": "split_rows"}).first()
    assert (r["n_rows"], r["n_seeds"], r["severities"], r["split_rows"], r["split_seeds"]) == (4, 3, {"S1": 1, "S4": 2}, {"train": 2, "val": 2}, {"train": 1, "val": 2})
    assert r["parameters"] == {}
    told = summary.manifest(x, {"s": "severities"}, parameters=summary.run_parameters("notes.csv", 0.5)).first()["parameters"]
    assert told == {"source": "notes.csv", "perturbation_rate": "0.5", "split_fractions": "0.8/0.1/0.1", "split_seed": "1337"}
    assert r["leakage_verified"] and len(r["caveats"]) == 3 and r["build_timestamp_utc"].endswith("Z")
    assert not summary.manifest(x.unionAll(x.withColumn("split", F.lit("test"))), {"s": "severities"}).first()["leakage_verified"]


def test_streams_drop_late_rows_and_go_on_after_a_restart(spark, tmp_path):
    from tessera.streaming import streams

    def put(rows):
        spark.createDataFrame(rows, "ts string, id bigint, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        live = spark.readStream.schema("ts timestamp, id bigint, v double").parquet(f"file://{tmp_path}/in")
        streams.run_once(streams.dedupe_ids(live, "ts", "id").select("id"), f"file://{tmp_path}/ids", f"file://{tmp_path}/c1")
        streams.run_once(streams.running_metrics(live, "ts", "v", "id"), f"file://{tmp_path}/means", f"file://{tmp_path}/c2")
        ids = sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/ids").collect())
        return ids, {(str(r["window_start"])[11:16], r["id"]): (r["n"], r["mean"]) for r in spark.read.schema("window_start timestamp, id bigint, n bigint, mean double").parquet(f"file://{tmp_path}/means").collect()}

    put([("2024-01-01 00:05:00", 1, 1.0), ("2024-01-01 00:06:00", 1, 3.0), ("2024-01-01 01:50:00", 2, 5.0)])
    assert run() == ([1, 2], {("00:00", 1): (2, 2.0)})
    # known ids within the watermark, a late row, and a row that closes the second hour
    put([("2024-01-01 01:55:00", 2, 7.0), ("2024-01-01 00:10:00", 3, 9.0), ("2024-01-01 03:30:00", 4, 1.0)])
    ids, means = run()
    assert ids == [1, 2, 4] and means == {("00:00", 1): (2, 2.0), ("01:00", 2): (2, 6.0)}


def observed(spark):
    """The session then has an observation, as any query before this one may have left it."""
    from pyspark.sql import Observation

    spark.range(3).observe(seen := Observation("before"), F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}


def test_linear_probe_learns(spark):
    observed(spark)
    rows = [(k, [float(k % 3 == j) * 2 + (k * 7 % 5) / 10 for j in range(3)], k % 3) for k in range(90)]
    x = V.linear_probe(spark.createDataFrame(rows, "id int, v array<float>, y int"), "v", "y")
    assert x.where("prediction = y").count() >= 85


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    from pyspark.sql import Observation

    x = spark.createDataFrame([("1", "a b", "x"), ("2", None, "x"), ("3", "", None)], "seed_id string, transcription string, medical_specialty string").repartition(3)
    assert notes.archive_notes(x, f"file://{tmp_path}/a") == {"n_before": 3, "n_after": 2, "n_null_text": 1}
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 2
    assert notes.archive_notes(x.limit(0), f"file://{tmp_path}/b") == {"n_before": 0, "n_after": 0, "n_null_text": 0}
    y = spark.createDataFrame([(k, t, "Surgery" if k % 2 else " ") for k, t in enumerate(["One two three", None, "one two", "a b c d", "", "x y z"])], "doc_id long, text string, raw_category string")
    r = builds.build_summary(y, "doc_id").first()
    # texts 0, 2, 4 have no category; 2, 4 are short
    assert r.asDict() == {"n_raw": 5, "n_kept": 2, "n_dropped": 3, "n_no_category": 3, "n_short": 2, "n_train": 1, "n_val": 0, "n_test": 1}
    notes.write_dataset(spark.createDataFrame([("a", "x", "val"), ("b", " ", "val"), ("c", "y", "train")], "id string, text string, split string"), f"file://{tmp_path}/d")
    seen = Observation("split")
    assert notes.read_split(spark, f"file://{tmp_path}/d", "val", seen=seen).count() == 1 and seen.get == {"n_before": 2, "n_blank": 1}


def test_cleaning_is_done_once(spark, monkeypatch):
    from tessera.catalogue import clinical

    plans = []
    monkeypatch.setattr(builds, "written", lambda df, name, f=builds.written: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, name))[1])
    last = builds.clean_build(clinical(spark, "/root/testdata/sf0.001"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert [p.count("san_nfc(") for p in plans] == [1] and "san_nfc" not in last


def test_a_leak_stops_the_write(spark, tmp_path):
    x = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "val")], "seed_id string, split string")
    S.without_leaks(x).write.parquet(f"file://{tmp_path}/good")
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 3
    leaky = S.without_leaks(x.unionAll(spark.createDataFrame([("b", "test")], x.schema)))
    with pytest.raises(Exception, match="1 groups are in two splits"):
        leaky.write.parquet(f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad" / "_SUCCESS").exists() and not list((tmp_path / "bad").glob("*.parquet"))
    assert S.without_leaks(x.limit(0)).count() == 0


def test_one_split_is_replaced_alone(spark, tmp_path):
    x = spark.createDataFrame([(k, s) for k in range(4) for s in ("train", "val", "test")], "k int, split string")
    path, files = f"file://{tmp_path}/d", lambda s: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "d" / f"split={s}").glob("*.parquet")}
    notes.write_dataset(x, path)
    before = {s: files(s) for s in ("train", "val", "test")}
    for _ in range(2):
        notes.replace_splits(spark.createDataFrame([(9, "val")], x.schema), path)
        assert files("train") == before["train"] and files("test") == before["test"] and files("val") != before["val"]
        assert sorted(map(tuple, spark.read.parquet(path).select("k", "split").collect())) == sorted([(k, s) for k in range(4) for s in ("train", "test")] + [(9, "val")])


def test_digests_do_not_depend_on_order_partitions_or_plans(spark):
    from tessera.operators.expand import expand_variants

    x = spark.createDataFrame([(k, None if k % 5 == 0 else f"t{k % 7}") for k in range(100)], "k int, t string")
    assert Q.expect_same(x, x.repartition(7).orderBy(F.desc("k"))).first()["same"]
    assert not Q.expect_same(x, x.unionAll(x.limit(1))).first()["same"]
    assert not Q.expect_same(x, x.withColumn("t", F.when(F.col("k") == 3, "other").otherwise(F.col("t")))).first()["same"]
    assert Q.digest(x.limit(0)).first().asDict() == {"n": 0, "digest": "0"}
    seeds = spark.createDataFrame([(str(k), "mera dard doctor ko") for k in range(20)], "seed_id string, text string")
    found, before = set(), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            for n in (1, 5):
                found.add(tuple(Q.digest(expand_variants(seeds.repartition(n)).select("tracking_id", "text")).first()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(found) == 1 and next(iter(found))[0] == 80


def test_sketches_of_splits_add_up(spark):
    from tessera.operators import summary
    from tessera.sources.shared import written

    x = spark.range(30_000).select((F.col("id") % 20_000).cast("string").alias("seed_id"), F.when(F.col("id") % 10 < 8, "train").otherwise("val").alias("split"))
    kept = written(summary.seed_sketches(x), "sketches")
    other = summary.seed_sketches(x.withColumn("split", F.col("seed_id").cast("int") % 3))
    told = summary.sketched_seeds(kept).first()["n"]
    assert abs(told - summary.sketched_seeds(other).first()["n"]) <= 0.01 * 20_000 and abs(told - 20_000) <= 0.02 * 20_000
    by = {r["split"]: r["n"] for r in summary.sketched_seeds(kept, "split").collect()}
    exact = {r["split"]: r["n"] for r in summary.with_total(x, "split", F.count_distinct("seed_id")).collect()}
    assert exact == {"train": 16_000, "val": 4_000, "all": 20_000} and all(abs(by[k] - exact[k]) <= 0.02 * exact[k] for k in by)


def test_near_copies_between_splits(spark):
    from tessera.operators.near_copies import near_leaks

    text = [f"w{k}" for k in range(40)]
    near = [*text[:39], "other"]  # 35 of 37 shingles
    far = [*text[:20], *(f"v{k}" for k in range(20))]
    rows = [(1, " ".join(text), "train"), (2, " ".join(text), "train"), (3, " ".join(near).upper(), "test"), (4, " ".join(far), "val"), (5, " ".join(text), "val"), (6, None, "val"), (7, " ", "train"), (8, " ", "test"), (9, "two words", "train"), (10, "Two  words", "test"), (11, " ".join(text), None)]
    got = {tuple(r) for r in near_leaks(spark.createDataFrame(rows, "doc_id long, text string, split string"), "doc_id").collect()}
    assert got == {("train", "val", 1, 5, 36, 36), ("train", "test", 1, 3, 35, 37), ("val", "test", 5, 3, 35, 37), ("train", "test", 9, 10, 1, 1)}
    assert near_leaks(spark.createDataFrame([], "doc_id long, text string, split string"), "doc_id").count() == 0


def test_shingles_are_made_once_from_each_text(spark, monkeypatch):
    from tessera.operators import near_copies

    seen = []
    monkeypatch.setattr(near_copies, "written", lambda df, name, kept=near_copies.written: (seen.append(df), kept(df, name))[1])
    rows = [(k, f"a b c d e f g {k % 3}", ("train", "val", "test")[k % 2]) for k in range(20)]
    assert near_copies.near_leaks(spark.createDataFrame(rows, "doc_id long, text string, split string"), "doc_id").count() == 3
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    assert [p.count("x20\\x09") for p in plans] == [1] + [0] * (len(plans) - 1)


def test_shingles_and_bands_against_plain_sets():
    import numpy as np
    from tessera.operators import near_copies

    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 6, n).astype(np.uint64) for n in (0, 3, 3, 40, 1, 5, 0, 4, 200, 6, 0)]
    texts[2] = texts[1]
    h, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    g, at = near_copies.shingles(h, first)
    sets = [{tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} if len(x) else set() for x in texts]
    assert np.diff(at).tolist() == [len(x) for x in sets]
    own = [set(g[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert all(len(x & y) == len(p & q) for x, p in zip(own, sets, strict=True) for y, q in zip(own, sets, strict=True))
    made = near_copies.bands(g, at)
    assert made.shape == (8, near_copies.BANDS) and (made[0] == made[1]).all() and not (made[0] == made[2]).any()
    # sets of 9 in 10 shared elements meet in (9 / 11) ** 2 of their bands, about two in three
    a = draw.integers(0, 1 << 63, (200, 100), np.uint64)
    b = np.concatenate([a[:, :90], draw.integers(0, 1 << 63, (200, 10), np.uint64)], axis=1)
    x, y = (near_copies.bands(z.ravel(), np.arange(0, 20_001, 100)) for z in (a, b))
    assert abs((x == y).mean() - (90 / 110) ** 2) < 0.04


def test_both_heads_learn_from_words(spark):
    from tessera.operators import probe

    observed(spark)
    heads = {"department": "department_code", "severity": "severity"}
    words = {"CARDIO": "heart valve pulse", "ORTHO": "knee bone joint", "ENT": "ear nose throat"}
    tiers = {"S1": "arrest collapse", "S4": "steady calm"}
    rows = [(f"{d}{s}{k}", d, s, f"{words[d].split()[k % 3]} filler{k % 11} {tiers[s].split()[k % 2]}", 0.25 if k % 4 == 0 else 1.0, "train" if k % 5 else "test") for d in words for s in tiers for k in range(30)]
    rows.append(("none", "ENT", "S4", None, 1.0, "test"))
    x = probe.indexed(spark.createDataFrame(rows, "seed_id string, department_code string, severity string, text string, weight double, split string"), heads)
    got = probe.predict(probe.fit_heads(x.where("split = 'train'"), heads, weight="weight"), x)
    assert got.columns[-2:] == ["department_prediction", "severity_prediction"] and got.count() == len(rows)
    held = {r["split"]: r for r in probe.accuracies(got, heads).collect()}["test"]
    assert held["n"] == 37 and held["department_accuracy"] > 0.95 and held["severity_accuracy"] > 0.95
    # rows of no weight teach nothing: the second half has its departments exchanged
    y = spark.createDataFrame([(d, w, t) for t in ("heart", "knee") for d, w in (("CARDIO", float(t == "heart")), ("ORTHO", float(t == "knee"))) for _ in range(5)], "department_code string, weight double, text string")
    y = probe.indexed(y, {"department": "department_code"})
    only = probe.predict(probe.fit_heads(y, {"department": "department_code"}, weight="weight"), y).where("weight = 1")
    assert only.where("department_prediction = department_index").count() == only.count() == 10


def put_rows(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def test_two_sinks_hold_each_row_once_after_a_failure(spark, tmp_path):
    from tessera.streaming import streams

    source, sinks = f"file://{tmp_path}/in", streams.quarantine_sinks(f"file://{tmp_path}/known", f"file://{tmp_path}/quarantine")

    def run(sure=lambda name, batch: None):
        live = streams.quarantine(spark.readStream.schema("id int, raw_category string").parquet(source))
        streams.run_split(live.select("id", "raw_label", "known"), sinks, f"file://{tmp_path}/offsets", sure)

    def fail(name, batch):
        if name == "known" and batch == 1:
            raise RuntimeError("lost in the middle of a batch")

    rows = spark.createDataFrame([(k, "Surgery" if k % 3 else "Nope") for k in range(30)], "id int, raw_category string")
    rows.where("id < 12").write.mode("append").parquet(source)
    run(fail)
    rows.where("id >= 12").write.mode("append").parquet(source)
    with pytest.raises(Exception, match="middle of a batch"):
        run(fail)
    assert spark.read.parquet(sinks["known"][0]).count() == 20 and spark.read.parquet(sinks["quarantine"][0]).count() == 4
    run()
    run()
    got = {name: sorted(r["id"] for r in spark.read.parquet(path).collect()) for name, (path, _) in sinks.items()}
    assert got == {"known": [k for k in range(30) if k % 3], "quarantine": [k for k in range(30) if k % 3 == 0]}


def test_epochs_reset_the_metrics_and_timers_end_them(spark, tmp_path):
    from tessera.catalogue import _rocksdb
    from tessera.streaming import streams

    schema = "ts string, head string, epoch int, loss double, n int, correct int"
    batches = [
        [("2024-01-01 00:00:00", "a", 1, 1.0, 10, 5), ("2024-01-01 00:01:00", "a", 1, 3.0, 30, 5), ("2024-01-01 00:02:00", "b", 1, 2.0, 1, 1)],
        [("2024-01-01 00:03:00", "a", 1, 5.0, 10, 2), ("2024-01-01 00:04:00", "a", 2, 1.0, 10, 5), ("2024-01-01 00:05:00", "a", 2, 2.0, 30, 30)],
        # a row of an epoch that has gone out, and one so late that all open epochs end
        [("2024-01-01 05:00:00", "a", 1, 9.0, 10, 0), ("2024-01-01 05:00:00", "c", 7, 1.0, 1, 1)],
    ]
    rows = [r for b in batches[:2] for r in b]
    want = {}
    for key, epoch in {(r[1], r[2]) for r in rows}:
        x = spark.createDataFrame([r[3:] for r in rows if r[1:3] == (key, epoch)], "loss double, n int, correct int")
        m = V.running_metrics(x).first()
        want[key, epoch] = (round(m["loss"], 9), round(m["accuracy"], 9), sum(r[4] for r in rows if r[1:3] == (key, epoch)))
    seen = []
    for b in batches:
        put_rows(spark, f"file://{tmp_path}/in", b, schema)
        with _rocksdb(spark):  # each run is a restart
            live = spark.readStream.schema(schema.replace("ts string", "ts timestamp")).parquet(f"file://{tmp_path}/in")
            streams.run_once(streams.epoch_metrics(live, "head", "epoch", "loss", "n", "correct", "ts"), f"file://{tmp_path}/out", f"file://{tmp_path}/offsets")
        seen.append({(r["key"], r["epoch"]): (round(r["loss"], 9), round(r["accuracy"], 9), r["n"]) for r in spark.read.schema(streams.EPOCHS).parquet(f"file://{tmp_path}/out").collect()})
    assert seen[0] == {} and seen[1] == {("a", 1): want["a", 1]} and seen[2] == want


def test_a_listener_sums_what_a_stream_has_seen(spark, tmp_path):
    from tessera.streaming import streams

    def run(name):
        live = spark.readStream.schema("transcription string, medical_specialty string").parquet(f"file://{tmp_path}/in")
        return streams.run_counted(notes.notes_validated(live, seen=name), f"file://{tmp_path}/out", f"file://{tmp_path}/offsets", name)

    for texts, n in ((["a", None], 1), (["b", None, None], 2)):
        spark.createDataFrame([(t, "x") for t in texts], "transcription string, medical_specialty string").write.mode("append").parquet(f"file://{tmp_path}/in")
        assert run(f"seen{n}") == {"n_before": len(texts), "n_after": 1, "n_null_text": n}
    assert spark.read.schema("transcription string, medical_specialty string").parquet(f"file://{tmp_path}/out").count() == 2


def test_splits_are_read_alone(spark, tmp_path):
    x = spark.createDataFrame([("a", "x", "train"), ("b", None, "train"), ("c", " ", "train")], "tracking_id string, text string, split string")
    notes.write_dataset(x, f"file://{tmp_path}/d")
    assert notes.read_split(spark, f"file://{tmp_path}/d", "train").count() == 1
    with pytest.raises(ValueError, match="train"):
        notes.read_split(spark, f"file://{tmp_path}/d", "val")


def test_builds_do_not_depend_on_partitions(spark):
    from tessera.catalogue import clinical

    x = clinical(spark, "/root/testdata/sf0.001")
    a, b = builds.variant_build(x), builds.variant_build(x.repartition(7))
    assert Q.same_rows(a, b) and a.count() == 752
    by = dict(a.groupBy("severity_heuristic").count().collect())
    seeds = dict(a.where("variant_index = 0").groupBy("severity_heuristic").count().collect())
    assert by == {k: 4 * n for k, n in seeds.items()}


def test_heads_count_words_once(spark, monkeypatch):
    from tessera.operators import probe

    seen = []
    monkeypatch.setattr(probe, "written", lambda df, name, f=probe.written: (seen.append(name), f(df, name))[1])
    rows = spark.createDataFrame([(f"{w} zz {k}", k % 2) for k, w in enumerate(["a b", "c d"] * 10)], "text string, y_index int")
    model = probe.fit_heads(rows, {"y": "y"}, places=64, steps=5)
    assert seen == ["counts"]
    assert [(r["y_index"], r["y_prediction"]) for r in probe.predict(model, rows).collect()] == [(k % 2, k % 2) for k in range(20)]
