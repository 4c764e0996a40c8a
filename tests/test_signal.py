import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import diarise, signal


def table(spark, arrays, rate=1000):
    rows = [(r, i, float(v), rate) for r, a in enumerate(arrays) for i, v in enumerate(a)]
    return spark.createDataFrame(rows, "recording_id bigint, pos bigint, value double, sample_rate int")


def waves(seed=0, n=5):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        size = int(rng.integers(5, 3000))
        loud = np.repeat(rng.choice([0.0, 0.001, 0.5, 1.0], size // 100 + 1), 100)[:size]
        out.append(loud * rng.normal(size=size))
    return out


def plain_snr(x, rate):
    n = int(0.02 * rate)
    if len(x) < n:
        return 30.0
    e = np.sort((x[: len(x) // n * n].reshape(-1, n) ** 2).mean(axis=1))
    top, low = max(1, int(0.3 * len(e))), max(1, int(0.2 * len(e)))
    noise = e[:low].mean()
    return 40.0 if noise <= 1e-10 else 10 * np.log10(max(e[-top:].mean() / noise, 1e-5))


def plain_vad(x, rate):
    n = int(rate * 30 / 1000)
    count, total = len(x) // n, round(len(x) / rate, 2)
    if count == 0:
        return [(0.0, total)]
    e = np.sqrt((x[: count * n].reshape(-1, n) ** 2).mean(axis=1))
    limit = max(1e-4, np.percentile(e, 30) * 1.5)
    chunks, start, last = [], None, None
    for i, loud in enumerate(e > limit):
        if loud:
            start = i if start is None else start
            last = i
        elif start is not None and i - last >= 13:
            if round(last * 30 / 1000, 2) > round(start * 30 / 1000, 2):
                chunks.append((round(start * 30 / 1000, 2), round(last * 30 / 1000, 2)))
            start = None
    if start is not None:
        chunks.append((round(start * 30 / 1000, 2), total))
    return chunks or [(0.0, total)]


def test_snr(spark):
    arrays = waves(1, 6) + [np.zeros(500), np.ones(7)]
    got = {r.recording_id: r.snr_db for r in signal.snr_db(table(spark, arrays)).collect()}
    for r, a in enumerate(arrays):
        np.testing.assert_allclose(got[r], plain_snr(a, 1000), rtol=1e-9)


def test_energy_vad(spark):
    arrays = waves(2, 8) + [np.zeros(500), np.ones(7)]
    got = {}
    for r in signal.energy_vad(table(spark, arrays)).orderBy("recording_id", "start_time").collect():
        got.setdefault(r.recording_id, []).append((r.start_time, r.end_time))
    assert got == {r: plain_vad(a, 1000) for r, a in enumerate(arrays)}


def test_frames_and_windows(spark):
    x = [np.concatenate([np.full(512, 0.001), np.full(512, 0.5), np.ones(9)])]
    got = [r.loud for r in signal.frame_energy(table(spark, x), 512, 0.02).orderBy("frame").collect()]
    assert got == [False, True]
    for win, step in ((12, 3), (10, 4), (5, 5), (7, 2)):
        a = waves(3, 1)[0]
        got = [r.energy for r in signal.sliding_energy(table(spark, [a]), win, step).orderBy("win_idx").collect()]
        want = [np.sqrt((a[i : i + win] ** 2).mean()) for i in range(0, len(a) - win + 1, step)]
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_resample(spark):
    for rate, target, size in ((32, 16, 8), (16, 16, 5), (8, 16, 7), (40, 16, 7), (44, 16, 100), (11, 16, 33)):
        a = np.arange(size) ** 1.5
        got = [r.value for r in signal.linear_resample(table(spark, [a], rate), target, block_rows=5).orderBy("pos").collect()]
        ratio = rate / target
        at = np.arange(int(size / ratio)) * ratio
        np.testing.assert_allclose(got, np.interp(at, np.arange(size), a))
    assert len(got) == int(33 / (11 / 16))


def test_downmix(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 8), (1, 1, 0, 0.0, 8)], "recording_id bigint, channel int, pos bigint, value double, sample_rate int")
    assert signal.downmix(df).first().value == 0.5


def labelled(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "recording_id bigint, win_idx bigint, label bigint, energy double")


def out(df):
    return [r.label for r in df.orderBy("win_idx").collect()]


def test_label_filters_against_plain_rules(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 6, 7, 40):
        labels = [int(v) for v in rng.integers(0, 3, n)]
        energy = [float(v) for v in rng.random(n)]
        df = labelled(spark, list(zip(labels, energy)))
        vote = list(labels)
        if n >= 3:
            for i in range(1, n - 1):
                vals, counts = np.unique(labels[i - 1 : i + 2], return_counts=True)
                vote[i] = int(vals[counts.argmax()])
        k = min(7, n)
        k = max(1, k - 1) if k % 2 == 0 else k
        pad = [0] * (k // 2) + labels + [0] * (k // 2)
        median = [sorted(pad[i : i + k])[k // 2] for i in range(n)]
        hold = float(np.percentile(energy, 20))
        gated, now = [labels[0]], labels[0]
        for i in range(1, n):
            ahead = range(i, min(i + 4, n))
            quiet = energy[i] < hold
            if quiet or (all(labels[j] == labels[i] for j in ahead) and any(energy[j] < hold for j in ahead)):
                now = labels[i]
            gated.append(now)
        for width in (2, 5, 8192):
            assert out(diarise.majority_vote(df, block_rows=width)) == vote
            assert out(diarise.median_filter(df, block_rows=width)) == median
            h = spark.createDataFrame([(1, hold)], "recording_id bigint, hold double")
            assert out(diarise.gate_transitions(df.withColumnRenamed("label", "raw_label"), h, block_rows=width)) == gated


def test_majority_vote_fact(spark):
    df = labelled(spark, [(v, 1.0) for v in (0, 2, 0, 1, 1, 1, 0)])
    assert out(diarise.majority_vote(df))[1] == 0


def test_labels_to_segments(spark):
    df = labelled(spark, [(v, 1.0) for v in (0, 0, 1, 1, 0)])
    dur = spark.createDataFrame([(1, 3.0)], "recording_id bigint, duration_seconds double")
    for width in (2, 8192):
        got = diarise.labels_to_segments(df, dur, 0.5, 0.25, block_rows=width).orderBy("seg_no").collect()
        assert [(r.speaker_id, r.start_time, r.end_time) for r in got] == [
            ("SPEAKER_00", 0.0, 1.25), ("SPEAKER_01", 1.25, 2.25), ("SPEAKER_00", 2.25, 3.0)]


def test_fill_labels(spark):
    rows = [(None, 1.0), (None, 1.0), (2, 1.0), (None, 1.0), (1, 1.0), (None, 1.0)]
    df = labelled(spark, rows).withColumnRenamed("label", "raw_label")
    for width in (1, 2, 8192):
        assert out(diarise.fill_labels(df, block_rows=width)) == [2, 2, 2, 2, 1, 1]


def test_cosine(spark):
    a, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    b, c = F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0))
    row = spark.range(1).select(*[diarise.cosine_similarity(x, y).alias(str(i)) for i, (x, y) in enumerate(((a, a), (a, b), (a, z), (a, c)))]).first()
    assert list(row) == [1.0, 0.0, 0.0, 0.0]
