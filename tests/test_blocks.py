import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions.numbers import exact_round
from voxloom.operators import blocks as B
from voxloom.operators import jobs, transcripts


def windows():
    w = Window.partitionBy("k").orderBy("i")
    far = Window.unboundedPreceding, Window.unboundedFollowing
    return w, w.rowsBetween(far[0], 0), w.rowsBetween(*far)


def frame(spark, seed=1, gaps=False):
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        i = 0
        for _ in range(rng.randint(1, 40)):
            i += rng.randint(1, 7) if gaps else 1
            rows.append((k, i - 1, rng.choice("AB"), rng.choice([None, 1.0, 2.0])))
    return spark.createDataFrame(rows, "k long, i long, s string, v double")


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_running(spark):
    W, HERE, ALL = windows()
    for gaps in (False, True):
        df = frame(spark, 2, gaps)
        got = B.running(
            df, ["k"], ["i"], B.block_of("i", 3),
            sums={"c": F.lit(1)}, lasts={"l": F.col("v")}, maxes={"m": F.col("v")},
            prevs={"p": F.col("v")}, nexts={"n": F.col("s")},
            total_sums={"t": F.lit(1)}, total_maxes={"tm": F.col("i")}, total_firsts={"f": F.col("v")},
        )
        want = df.select(
            "*", F.count(F.lit(1)).over(HERE).alias("c"), F.last("v", True).over(HERE).alias("l"), F.max("v").over(HERE).alias("m"),
            F.lag("v").over(W).alias("p"), F.lead("s").over(W).alias("n"), F.count(F.lit(1)).over(ALL).alias("t"),
            F.max("i").over(ALL).alias("tm"), F.first("v", True).over(ALL).alias("f"),
        )
        same(got, want)


def test_running_descending_and_without_key(spark):
    df = frame(spark, 3).where("k = 0")
    got = B.running(df, [], [F.desc("i")], -B.block_of("i", 4), sums={"c": F.lit(1)}, lasts={"l": F.col("v")})
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    same(got, df.select("*", F.count(F.lit(1)).over(w).alias("c"), F.last("v", True).over(w).alias("l")))


def test_islands(spark):
    W, HERE, _ = windows()
    for width in (1, 2, 3, 1000):
        df = frame(spark, 4, True)
        got = B.islands(df, ["k"], ["i"], B.block_of("i", width), ["s"], lambda p, c, n: p["s"] != c["s"])
        flag = F.coalesce(F.lag("s").over(W) != F.col("s"), F.lit(True))
        idx = F.row_number().over(W) - 1
        want = df.withColumn("idx", idx).withColumn("o", F.when(flag, F.col("idx")))
        want = want.select("k", "i", "idx", F.max("o").over(HERE).alias("island"), F.lag("s").over(W).alias("p"), F.lead("s").over(W).alias("n"))
        same(got.select("k", "i", "idx", "island", F.col("prev.s").alias("p"), F.col("next.s").alias("n")), want)


def test_attach_and_pages(spark):
    df = frame(spark, 5)
    stats = spark.createDataFrame([(0, "x"), (2, "y")], "k long, z string")
    same(B.attach(df, stats, ["k"], B.block_of("i", 3)), df.join(stats, "k", "left").select(*df.columns, "z"))
    for how in ("left_semi", "left_anti"):
        same(B.attach(df, stats, ["k"], B.block_of("i", 3), how), df.join(stats, "k", how))
    pages = B.nest_pages(df, ["k"], ["i"], B.block_of("i", 3), F.col("i"), 7).collect()
    assert all(len(p["items"]) <= 7 for p in pages)
    for k in range(6):
        mine = sorted((p for p in pages if p.k == k), key=lambda p: p.page_no)
        assert [i for p in mine for i in p["items"]] == list(range(df.where(f"k = {k}").count()))


def test_percentiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vals = np.round(rng.normal(size=300) * 5, 1)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vals)], "k long, v double")
    got = B.percentiles(df, ["k"], "v", {"a": 0.3, "b": 0.5, "c": 1.0}).collect()
    for r in got:
        mine = vals[np.arange(300) % 3 == r.k]
        np.testing.assert_allclose([r.a, r.b, r.c], np.percentile(mine, [30, 50, 100]))


def test_ranks_are_exact_at_any_range(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    wide = np.concatenate([10.0 ** rng.uniform(-320, 308, 400), -(10.0 ** rng.uniform(-320, 308, 400)), [0.0, -0.0, 5e-324]])
    dense = 1.0 + np.arange(3000) * 2.0**-52
    crowd = np.repeat(rng.normal(size=7), 400)
    data = {"wide": wide, "dense": rng.permutation(dense), "crowd": rng.permutation(crowd), "one": np.array([3.5])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"first": lambda n: n - n, "third": lambda n: F.floor(n / 3), "last": lambda n: n - 1}
    got = {r.k: r for r in B.select_ranks(df, ["k"], "v", at).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        order, n = np.sort(vs), len(vs)
        assert [got[k].first, got[k].third, got[k].last, got[k].n] == [order[0], order[n // 3], order[-1], n]
        if k != "wide":
            np.testing.assert_allclose([got[k].third_below, got[k].last_below], [order[: n // 3].sum(), order[:-1].sum()], rtol=1e-9, atol=1e-9)


def test_exact_round(spark):
    rng = random.Random(3)
    vals = [2.675, 0.125, 0.375, 1.005, -1.005, -0.125] + [rng.randint(0, 10**7) / 1000 for _ in range(5000)]
    got = spark.createDataFrame([(v,) for v in vals], "v double").select("v", exact_round(F.col("v")).alias("r")).collect()
    assert all(x.r == round(x.v, 2) for x in got)


def test_the_summary_reuses_the_shuffle(spark):
    df = frame(spark, 6).select("k", "i", "s")
    out = B.islands(df, ["k"], ["i"], B.block_of("i", 3), ["s"], lambda p, c, n: p["s"] != c["s"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.select("k", "i", "s", "island")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan


def test_null_keys_and_blocks_lose_no_row(spark):
    rows = [(k, i, f"{k}{i}{n}", 1.0 * n) for k in (None, 0, 1) for i in (None, 0, 1, 5, 9) for n in range(3)]
    df = spark.createDataFrame(rows, "k long, i long, s string, v double")
    blk = B.block_of("i", 3)
    numbered = F.row_number().over(Window.partitionBy("k").orderBy("i", "s")).cast("long").alias("c")
    same(B.row_numbers(df, ["k"], ["i", "s"], blk, "c"), df.select("*", numbered))
    back = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("i"), F.desc("s"))).cast("long").alias("c")
    same(B.row_numbers(df, ["k"], [F.desc("i"), F.desc("s")], -blk, "c"), df.select("*", back))
    found = B.islands(df, ["k"], ["i", "s"], blk, ["i"], lambda p, c, n: c["i"] - p["i"] > 1)
    same(found.select("k", "s", (F.col("idx") + 1).alias("c")), df.select("k", "s", numbered))
    pages = B.nest_pages(df, ["k"], ["i", "s"], blk, F.col("s"), 4)
    same(pages.select("k", F.explode("items").alias("s")), df.select("k", "s"))
    ranks = B.select_ranks(df, ["k"], "v", {"mid": lambda n: F.floor(n / 2)}).collect()
    assert {(r.k, r.mid, r.mid_below, r.n, r.sum) for r in ranks} == {(k, 1.0, 2.0, 15, 15.0) for k in (None, 0, 1)}
    stats = spark.createDataFrame([(0, "a")], "k long, t string")
    counts = {how: B.attach(df, stats, ["k"], blk, how).count() for how in ("left", "inner", "left_semi", "left_anti")}
    assert counts == {"left": 45, "inner": 15, "left_semi": 15, "left_anti": 30}
    assert B.attach(df, stats, ["k"], blk).where("t = 'a'").count() == 15


def test_rows_without_a_time_stay_in_records_waves_and_limits(spark):
    u = spark.createDataFrame(
        [("r", f"u{i}", "A", t, t, "x", i) for i, t in enumerate([None, 0.0, None, 700.0])],
        "recording_id string, utterance_id string, speaker_id string, start_time double, end_time double, text string, created_no long",
    )
    records = spark.createDataFrame([("r",)], "recording_id string")
    page = transcripts.record_pages(records, u, ["created_no", "utterance_id"]).collect()
    assert [x.utterance_id for x in page[0].utterances] == ["u0", "u2", "u1", "u3"]
    d = spark.createDataFrame([(f"d{i}", "http://a/b", t) for i, t in enumerate([None, 5, 6])], "delivery_id string, url string, next_attempt_at long")
    assert {(r.delivery_id, r.wave) for r in jobs.host_waves(d, 2).collect()} == {("d0", 0), ("d1", 0), ("d2", 1)}
    q = spark.createDataFrame([("e0", "c", None), ("e1", "c", "2020-01-01 00:00:00"), ("e2", None, None)], "event_id string, client string, ts string")
    q = q.withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.event_id, r.request_no, r.code) for r in jobs.rate_limit(q).collect()} == {(e, 1, 202) for e in ("e0", "e1", "e2")}
    block = B.block_of("start_time", 600.0)
    ids, none = records.select(F.col("recording_id").alias("job_id")), spark.createDataFrame([], "job_id string, at long")
    assert [t.count() for t in jobs.cascade_delete(ids, u, none, ids, block, B.block_of("at", 1))] == [0, 0, 0]
    assert jobs.backfill(ids, ids.limit(0), u, block)[1].count() == 4


def test_range_running_splits_a_burst(spark):
    """A key with most rows, all due at one time, is numbered in order over many ranges; null keys are one key."""
    df = spark.range(20000).selectExpr("case when id % 10 < 8 then 'hot' when id % 10 = 8 then null else 'b' end k", "0 at", "id", "id % 3 v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for desc in (False, True):
            out = B.range_running(df, ["k"], ["at", "id"], {"n": F.lit(1).cast("long"), "s": F.col("v")}, desc)
            rows = out.collect()
            assert len(rows) == 20000
            for k in ("hot", None, "b"):
                mine = sorted((r for r in rows if r.k == k), key=lambda r: r.id, reverse=desc)
                assert [r.n for r in mine] == list(range(1, len(mine) + 1))
                assert [r.s for r in mine] == [sum(r.v for r in mine[: i + 1]) for i in range(3)] + [mine[i].s for i in range(3, len(mine))]
                assert mine[-1].s == sum(r.v for r in mine)
        sizes = [r["count"] for r in df.repartitionByRange("k", "at", "id").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 20000 / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert B.range_running(df.limit(0), ["k"], ["at", "id"], {"n": F.lit(1)}).count() == 0


def test_short_row_numbers_equal_the_rule_for_short_and_long_keys(spark):
    rows = [(k, n * 37 % 101) for k, size in ((1, 3), (2, 50), (None, 20), (3, 1)) for n in range(size)]
    df = spark.createDataFrame(rows, "k long, o long")
    whole = {}
    for k, o in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        whole[k, o] = whole.get(("n", k), 0) + 1
        whole["n", k] = whole[k, o]
    for few in (10, 1000):
        out = B.short_row_numbers(df, ["k"], ["o"], B.block_of("o", 16), "no", few)
        got = {(r.k, r.o): r.no for r in out.collect()}
        assert got == {key: n for key, n in whole.items() if key[0] != "n"}
    out = B.short_row_numbers(df, ["k"], ["o"], B.block_of("o", 16), "no", 1000)
    shuffles = out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 1  # short keys: the rows move once, without summaries
