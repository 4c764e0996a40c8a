import numpy as np

from voxloom.operators import similar

SCHEMA = "recording_id bigint, win_idx bigint, embedding array<double>"


def plain(rows, k):
    """All pairs, one by one."""
    out = set()
    for rec, i, x in rows:
        found = []
        for other, j, y in rows:
            if other != rec or i == j or not x or not y or len(x) != len(y):
                continue
            a, b = np.asarray(x), np.asarray(y)
            norm = np.sqrt(a @ a) * np.sqrt(b @ b)
            found.append((-(round(float(a @ b / norm), 6) if norm else 0.0), j))
        out |= {(rec, i, n + 1, j, -s + 0.0) for n, (s, j) in enumerate(sorted(found)[:k])}
    return out


def got(df):
    return {(r.recording_id, r.win_idx, r.rank, r.other_idx, round(r.similarity, 6) + 0.0) for r in df.collect()}


def speakers(rng, n, dims=4):
    """Turns of a few voices with copies, zero vectors and a vector of another length."""
    centres = rng.normal(size=(4, dims)) * 10
    voice = np.repeat(rng.integers(0, 4, n // 6 + 1), 6)[:n]
    return [[round(float(v), 2) for v in centres[s] + rng.normal(size=dims) * (i % 5 > 0)] for i, s in enumerate(voice)]


def test_best_partners_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, v) for i, v in enumerate(speakers(rng, 90))] + [(2, 7, [1.0, 2.0])] + [(None, i, [1.0, float(i)]) for i in range(3)]
    rows += [(3, i, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], None, [], [1.0, 0.0, 0.0], [-1.0, 0.0], [0.0, 2.0], [2.0, 0.0]])]
    df = spark.createDataFrame(rows, SCHEMA)
    for tile in (4, 512):
        assert got(similar.similar_windows(df, 3, tile)) == plain(rows, 3)
    named = [(f"job-{rec}", i, v) for rec, i, v in rows]
    df = spark.createDataFrame(named, SCHEMA.replace("recording_id bigint", "recording_id string"))
    assert got(similar.similar_windows(df, 3, 4)) == plain(named, 3)


def test_far_tiles_never_meet(spark, monkeypatch):
    met = []
    real = similar.meeting
    monkeypatch.setattr(similar, "meeting", lambda tiles: met.append(real(tiles)) or met[0])
    rng = np.random.default_rng(6)
    axis = np.eye(8)
    rows = [(1, i, [float(v) for v in axis[i // 40] + rng.normal(size=8) * 1e-3]) for i in range(320)]
    out = similar.similar_windows(spark.createDataFrame(rows, SCHEMA), 5, 20).collect()
    assert len(out) == 320 * 5 and all(r.win_idx // 40 == r.other_idx // 40 for r in out)
    # of 16 tiles each meets only the other one of its voice
    assert {(r.tile, r.partner) for r in met[0].collect()} == {(t, t ^ 1) for t in range(16)}


def test_no_windows(spark):
    assert similar.similar_windows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_window_is_sent_at_most_sixteen_times_however_long_its_recording(spark, monkeypatch):
    """Small tiles of a long recording without structure: their number, which every window is sent to, doesn't grow; pieces meet as whole tiles do."""
    met = []
    real = similar.meeting
    monkeypatch.setattr(similar, "meeting", lambda tiles: met.append(real(tiles)) or met[-1])
    monkeypatch.setattr(similar, "PIECE", 7)
    rng = np.random.default_rng(9)
    for n in (120, 480):
        rows = [(1, 3 * i, [float(round(v, 1)) for v in rng.normal(size=4)]) for i in range(n)]
        rows[5] = rows[50] = rows[90] = (1, 3 * n, rows[5][2])
        rows = list({r[1]: r for r in rows}.values())
        assert got(similar.similar_windows(spark.createDataFrame(rows, SCHEMA), 3, 4)) == plain(rows, 3)
    for pairs in met:
        tiles = {r.tile for r in pairs.collect()}
        assert len(tiles) <= similar.TILES and pairs.count() <= similar.TILES * (similar.TILES - 1)


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(similar, "PIECE", 8)
    rows = [(1, i, [1.0, 0.0] if i % 5 else [float(i % 3), 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(similar.similar_windows(df, 4, 4)) == plain(rows, 4)
