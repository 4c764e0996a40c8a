import math
import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import intervals, utterances
from voxloom.plans import jobs as plans
from voxloom.params import Params

WORDS = "recording_id bigint, pos bigint, word string, start_time double, end_time double"
SEGS = "recording_id bigint, seg_no bigint, speaker_id string, start_time double, end_time double"


def speaker_of(w, segs):
    mid = (w[3] + w[4]) / 2
    for s in segs:
        if s[3] <= mid <= s[4]:
            return s[2]
    best, name = 0.0, "SPEAKER_UNKNOWN"
    for s in segs:
        shared = min(w[4], s[4]) - max(w[3], s[3])
        if shared > best:
            best, name = shared, s[2]
    return name


def plain_fuse(words, segs, silence=1.5):
    spk = [speaker_of(w, segs) for w in words]
    for i in range(1, len(spk) - 1):
        if spk[i - 1] == spk[i + 1] != spk[i]:
            spk[i] = spk[i - 1]
    groups = []
    for w, s in zip(words, spk):
        if groups and groups[-1][0] == s and w[3] - groups[-1][1][-1][4] <= silence:
            groups[-1][1].append(w)
        else:
            groups.append((s, [w]))
    out, names = [], {}
    for s, ws in groups:
        text = " ".join(w[2].strip() for w in ws if w[2].strip())
        if text:
            if s != "SPEAKER_UNKNOWN":
                s = names.setdefault(s, f"SPEAKER_{len(names):02d}")
            out.append((s, ws[0][3], ws[-1][4], text))
    return out


def fused(spark, words, segs, **kw):
    df = utterances.fuse(spark.createDataFrame(words, WORDS), spark.createDataFrame(segs, SEGS), **kw)
    out = {}
    for r in df.orderBy("recording_id", "utt_key").collect():
        out.setdefault(r.recording_id, []).append((r.speaker_id, r.start_time, r.end_time, r.text))
    return out


def case(rng, rec):
    words, ms = [], 0
    for i in range(rng.randint(1, 40)):
        ms += rng.choice([0, 100, 300, 1500, 1600, 2500])
        end = ms + rng.choice([100, 300, 400])
        words.append((rec, i, rng.choice(["w", " x", "  ", "y "]), ms / 1e3, end / 1e3))
        ms = end
    segs = []
    for i in range(rng.randint(0, 25)):
        a = rng.randint(0, max(1, ms))
        segs.append((rec, i, rng.choice("ABC"), a / 1e3, (a + rng.choice([0, 200, 700, 4000, 90000])) / 1e3))
    return words, segs


def test_fuse_matches_sequential_rule(spark):
    rng = random.Random(11)
    words, segs, want = [], [], {}
    for rec in range(120):
        w, s = case(rng, rec)
        words, segs = words + w, segs + s
        if plain_fuse(w, s):
            want[rec] = plain_fuse(w, s)
    assert fused(spark, words, segs) == want
    assert fused(spark, words, segs, block_rows=3) == want


def test_small_conversation(spark):
    words = [(1, i, *w) for i, w in enumerate([
        ("Merhaba", 0.0, 0.5), ("nasılsınız", 0.6, 1.2), ("Ben", 1.3, 1.5), ("iyiyim", 1.6, 2.0), ("Teşekkürler", 4.0, 4.8)])]
    segs = [(1, 0, "SPEAKER_00", 0.0, 1.25), (1, 1, "SPEAKER_01", 1.28, 2.1), (1, 2, "SPEAKER_00", 3.9, 5.0)]
    got = fused(spark, words, segs)[1]
    assert [g[0] for g in got] == ["SPEAKER_00", "SPEAKER_01", "SPEAKER_00"]
    assert [g[3] for g in got] == ["Merhaba nasılsınız", "Ben iyiyim", "Teşekkürler"]
    assert fused(spark, words[:1], [])[1] == [("SPEAKER_UNKNOWN", 0.0, 0.5, "Merhaba")]


def test_overlaps(spark):
    segs = spark.createDataFrame([(1, 0, "B", 0.0, 3.0), (1, 1, "A", 2.0, 5.0), (2, 0, "A", 0.0, 5.0)], SEGS)
    rec = spark.createDataFrame([(1, 10.0), (2, 10.0)], "recording_id bigint, effective_duration double")
    for width in (0.5, 60.0):
        pairs = intervals.overlap_pairs(segs, bin_seconds=width)
        got = {r.recording_id: r for r in intervals.overlap_summary(rec, intervals.overlap_totals(segs, bin_seconds=width)).collect()}
        assert (got[1].interrupt_count, got[1].total_overlap_seconds, got[1].overlap_percentage) == (1, 1.0, 10.0)
        assert (got[2].interrupt_count, got[2].total_overlap_seconds) == (0, 0.0)
        p = pairs.collect()[0]
        assert (p.speakers, p.start_time, p.end_time) == (["A", "B"], 2.0, 3.0)


def test_overlap_pairs_match_nested_loops(spark):
    rng = random.Random(12)
    rows = [(r, i, rng.choice("ABC"), a / 1000, (a + rng.randint(0, 9000)) / 1000) for r in range(5) for i, a in enumerate(rng.choices(range(30000), k=25))]
    want = set()
    for a in rows:
        for b in rows:
            later = (a[3], a[1]) < (b[3], b[1])
            lo, hi = max(a[3], b[3]), min(a[4], b[4])
            if a[0] == b[0] and later and a[2] != b[2] and b[3] < a[4] and hi - lo > 0.05:
                want.add((a[0], a[1], b[1], round(lo, 2), round(hi, 2), round(hi - lo, 2)))
    df = spark.createDataFrame(rows, SEGS)
    for width in (1.0, 60.0):
        got = intervals.overlap_pairs(df, bin_seconds=width)
        assert {(r.recording_id, r.i_seg, r.j_seg, r.start_time, r.end_time, r.duration) for r in got.collect()} == want
        assert got.count() == len(want)


def totals(df, width=60.0, floor=0.05):
    out = intervals.overlap_totals(df, floor, bin_seconds=width).collect()
    return {r.recording_id: (r.pairs, pytest.approx(r.overlap_seconds, abs=1e-6)) for r in out}


def test_overlap_totals_equal_the_pairs(spark):
    """Hundredths make many overlaps of just the floor, whose test rounds either way; equal starts, ends and rows of no
    length or no speaker are among them."""
    rng = random.Random(5)
    rows = [
        (r, i, rng.choice(["A", "B", "C", None]), a / 100, (a + rng.choice([0, 4, 5, 6, 10, 300])) / 100)
        for r in range(6)
        for i, a in enumerate(rng.choices(range(200 * r + 40), k=150))
    ]
    rows += [(9, i, "AB"[i % 2], 1.0, 1.05) for i in range(20)] + [(10, 0, "A", None, 2.0), (10, 1, "B", 1.0, None), (None, 0, "A", 0.0, 2.0)]
    rows += [(11, i, "A", float(i), i + 3.0) for i in range(9)]
    df = spark.createDataFrame(rows, SEGS)
    for floor in (0.0, 0.05, 0.06):
        pairs = intervals.overlap_pairs(df, floor).groupBy("recording_id").agg(F.count("*"), F.sum("overlap_seconds"))
        want = {r[0]: (r[1], r[2]) for r in pairs.collect()}
        for width in (0.5, 60.0):
            assert totals(df, width, floor) == want
    assert totals(df.limit(0)) == {}


def test_overlap_percentage_rounds_the_binary_difference(spark):
    """2.3 - 2.0 lies below 0.3, so 16 seconds of it are less than 1.875 %; so does the sum of three of these of 240."""
    one = [(1, 0, "A", 0.0, 2.3), (1, 1, "B", 2.0, 9.0)]
    three = [(2, 2 * n + k, "AB"[k], s, e) for n, (lo, hi) in enumerate([(2.0, 2.3), (102.2, 102.5), (150.8, 151.1)]) for k, (s, e) in enumerate([(lo - 1.0, hi), (lo, hi + 1.0)])]
    segs = spark.createDataFrame(one + three, "recording_id long, seg_no long, speaker_id string, start_time double, end_time double")
    rec = spark.createDataFrame([(1, 16.0), (2, 240.0)], "recording_id long, effective_duration double")
    totals = intervals.overlap_totals(segs)
    exact = {r.recording_id: r.overlap_seconds for r in totals.collect()}
    assert exact == {1: 2.3 - 2.0, 2: math.fsum([2.3 - 2.0, 102.5 - 102.2, 151.1 - 150.8])}
    got = {r.recording_id: (r.overlap_percentage, r.total_overlap_seconds) for r in intervals.overlap_summary(rec, totals).collect()}
    assert got == {1: (1.87, 0.3), 2: (0.37, 0.9)}


def test_overlap_totals_of_ten_thousand_at_once(spark):
    n = 10000
    df = spark.range(n).selectExpr(
        "1L recording_id", "int(id) seg_no", "if(id % 2 = 0, 'A', 'B') speaker_id", "id / 1000D start_time", "100 + id / 1000D end_time"
    )
    # Every even one meets every odd one: 100 s less the distance of their starts.
    apart = sum(2 * (n - d) // 2 * d for d in range(1, n, 2)) / 1000
    (pairs, seconds), = totals(df).values()
    assert pairs == (n // 2) ** 2 and (n // 2) ** 2 * 100 - apart == seconds


def test_vad_filter(spark):
    rng = random.Random(13)
    words = [(r, i, "w", i * 0.4, i * 0.4 + 0.3) for r in range(4) for i in range(60)]
    speech = [(r, a, a + rng.choice([0.0, 1.0, 3.0])) for r in range(3) for a in (rng.uniform(0, 24) for _ in range(4))]
    want = [w for w in words if w[0] == 3 or any(a - 0.6 <= (w[3] + w[4]) / 2 <= b + 0.6 for r, a, b in speech if r == w[0])]
    sp = spark.createDataFrame(speech, "recording_id bigint, start_time double, end_time double")
    for width in (0.7, 60.0):
        got = intervals.vad_filter(spark.createDataFrame(words, WORDS), sp, bin_seconds=width, block_rows=7)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_suppress_repeats(spark):
    rng = random.Random(14)
    said = [rng.choice(["a", " A", "b"]) for _ in range(80)]
    kept = []
    for i, w in enumerate(said):
        low = [said[j].strip().lower() for j in kept[-2:]]
        if not (len(low) == 2 and low[0] == low[1] == w.strip().lower()):
            kept.append(i)
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(said)], "recording_id bigint, pos bigint, word string")
    for width in (1, 4, 1000):
        assert sorted(r.pos for r in utterances.suppress_repeats(df, width).collect()) == kept


def test_analyse_gates(spark):
    rec = spark.createDataFrame([(1, 30.0, 1), (2, 1.5, None), (3, 30.0, None)], "recording_id bigint, duration_seconds double, num_speakers int")
    words = spark.createDataFrame([(r, 0, "a", 0.0, 0.5) for r in (1, 2, 3)], WORDS)
    segs = spark.createDataFrame([(r, 0, "X", 0.0, 9.0) for r in (1, 2, 3)], SEGS)
    out = plans.analyse(rec, words, segs, None, Params(profile="feedback"))
    assert {r.recording_id: r.gate for r in out.summaries.collect()} == {1: "single", 2: "short", 3: "diarise"}
    assert {r.recording_id: r.speaker_id for r in out.utterances.collect()} == {1: "SPEAKER_00", 2: "SPEAKER_UNKNOWN", 3: "SPEAKER_00"}
    assert plans.single_speaker_segments(plans.diarise_gate(rec)).select(F.max("end_time")).first()[0] == 30.0


def test_words_without_times_are_kept(spark):
    words = spark.createDataFrame(
        [(1, 0, 0.0, 1.0, "a"), (1, 1, None, None, "b")], "recording_id bigint, pos bigint, start_time double, end_time double, word string"
    )
    segments = spark.createDataFrame(
        [(1, 0, "S", 0.0, 2.0), (1, 1, "T", None, None)], "recording_id bigint, seg_no bigint, speaker_id string, start_time double, end_time double"
    )
    from voxloom.operators import intervals

    assert intervals.attribute_words(words, segments).count() == 2


def test_summaries_alone_write_nothing(spark, monkeypatch):
    words = spark.createDataFrame([(1, 0, "a", 0.0, 1.0), (1, 1, "b", 5.0, 6.0)], WORDS)
    segs = spark.createDataFrame([(1, 0, "A", 0.0, 3.0), (1, 1, "B", 2.0, 6.0)], SEGS)
    rec = spark.createDataFrame([(1, 0.0, 2)], "recording_id bigint, duration_seconds double, num_speakers int")
    speech = spark.createDataFrame([(1, 0.0, 1.0)], "recording_id bigint, start_time double, end_time double")
    monkeypatch.setattr(plans, "cut", lambda *a: pytest.fail("written"))
    monkeypatch.setattr(utterances, "cut", lambda *a: pytest.fail("written"))
    # A diariser needs 45 s by default.
    out = plans.analyse(rec, words, segs, speech, Params(min_diarise_seconds=0.0))
    row = out.summaries.first()
    assert (row.effective_duration, row.interrupt_count, row.total_overlap_seconds, row.overlap_percentage) == (1.0, 1, 1.0, 100.0)
    assert out.pairs.count() == 1
