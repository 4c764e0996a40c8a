import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import cluster


def make(spark, sizes, speakers=3, d=6, seed=0, noise=0.25):
    rng = np.random.default_rng(seed)
    rows = []
    for rec, n in enumerate(sizes):
        centres = rng.normal(size=(speakers, d))
        for i in range(n):
            v = centres[(i // 5) % speakers] + noise * rng.normal(size=d)
            rows.append((rec, i, [float(x) for x in v]))
    return spark.createDataFrame(rows, "recording_id bigint, win_idx bigint, embedding array<double>"), rows


def labels(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.recording_id, {})[r.win_idx] = r.label
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def brute_linkage(x, k=None, threshold=0.55, cap=10):
    """Closest pair by closest pair over the full distance matrix."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = 1 - u @ u.T

    def run(stop):
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            best = min(
                (dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
            )
            if stop(len(groups), best[0]):
                break
            groups[best[1]] += groups.pop(best[2])
        return groups

    groups = run(lambda n, h: n <= k) if k else run(lambda n, h: h >= threshold)
    if not k and len(groups) > cap:
        groups = run(lambda n, h: n <= cap)
    label = {}
    for no, g in enumerate(sorted(groups, key=min)):
        for i in g:
            label[i] = no
    return [label[i] for i in range(len(x))]


def test_linkage_matches_brute_force(spark):
    for k in (None, 2, 4):
        df, rows = make(spark, [25, 1, 40], seed=3, noise=0.6)
        got = labels(cluster.cluster_average_linkage(df, k))
        for rec in got:
            x = np.array([r[2] for r in rows if r[0] == rec])
            want = brute_linkage(x, k) if len(x) > 1 else [0]
            assert got[rec] == want


def test_linkage_large_equals_small(spark):
    df, _ = make(spark, [60, 9], seed=5, noise=0.8)
    for k, threshold, cap in ((None, 0.55, 10), (None, 0.05, 4)):
        small = labels(cluster.cluster_average_linkage(df, k, threshold, cap))
        large = labels(cluster.cluster_average_linkage(df, k, threshold, cap, max_rows=24))
        assert small == large


def test_linkage_with_repeated_vectors_is_the_same_at_every_size(spark):
    """Ties everywhere: few distinct vectors, silent windows, and gaps in the numbers. Against the closest pair each time."""
    rng = np.random.default_rng(11)
    known = rng.normal(size=(6, 4)).round(1)
    known[5] = 0
    rows = [(rec, 3 * i + rec, [float(v) for v in known[rng.integers(0, 6)]]) for rec, n in enumerate((34, 30, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "recording_id bigint, win_idx bigint, embedding array<double>")
    for k, threshold, cap in ((4, 0.55, 10), (None, 0.55, 10), (None, 0.05, 3)):
        want = {}
        for rec in range(3):
            x = np.array([r[2] for r in rows if r[0] == rec])
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            u = x / np.where(norms == 0, 1, norms)
            groups = {i: [i] for i in range(len(x))}
            merges = []
            while len(groups) > 1:
                h, a, b = min((round(1 - u[g].sum(0) @ u[o].sum(0) / len(g) / len(o), 9), i, j) for i, g in groups.items() for j, o in groups.items() if i < j)
                merges.append((h, -b, a))
                groups[a] = groups[a] + groups.pop(b)
            kept = sorted(merges)[: len(x) - k] if k else [m for m in merges if m[0] < threshold]
            if not k and len(x) - len(kept) > cap:
                kept = sorted(merges)[: len(x) - cap]
            parent = {-b: a for _, b, a in kept}
            top = lambda i: top(parent[i]) if i in parent else i
            roots = sorted({top(i) for i in range(len(x))})
            want[rec] = [roots.index(top(i)) for i in range(len(x))]
        for max_rows in (4096, 12) if k else (4096,):
            assert labels(cluster.cluster_average_linkage(df, k, threshold, cap, max_rows)) == want, (k, cap, max_rows)


def test_bisect_is_the_same_in_any_blocks(spark):
    df, _ = make(spark, [70, 12], speakers=2, seed=1, noise=0.9)
    assert labels(cluster.cluster_bisect(df)) == labels(cluster.cluster_bisect(df, block_rows=10))


def test_bisect_separates_two_speakers(spark):
    df, _ = make(spark, [40], speakers=2, seed=2, noise=0.05)
    got = labels(cluster.cluster_bisect(df))[0]
    truth = [(i // 5) % 2 for i in range(40)]
    assert got == truth or got == [1 - t for t in truth]


def test_single_window_is_speaker_zero(spark):
    df, _ = make(spark, [1])
    assert labels(cluster.cluster_bisect(df))[0] == [0]
    assert labels(cluster.cluster_average_linkage(df))[0] == [0]


def test_recordings_named_by_strings(spark):
    df, _ = make(spark, [12, 5], seed=8, noise=0.8)
    named = df.withColumn("recording_id", F.concat(F.lit("r"), "recording_id"))
    known = {f"r{k}": v for k, v in labels(cluster.cluster_average_linkage(df, 3)).items()}
    assert labels(cluster.cluster_average_linkage(named, 3)) == known
    assert labels(cluster.cluster_average_linkage(named, 3, max_rows=8)) == known
    assert set(labels(cluster.cluster_bisect(named))) == set(known)


def test_bisect_writes_the_windows_twice_whatever_the_rounds(spark, monkeypatch):
    """Rounds write centroids, a row per recording; the windows' vectors are written before them only."""
    rng = np.random.default_rng(3)
    rows = [(r, i, rng.normal(size=6).tolist()) for r in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "recording_id string, win_idx long, embedding array<double>")
    written, keep = [], cluster.cut

    def spy(table, name="cut"):
        out = keep(table, name)
        written.append((name, "unit" in table.columns, out.count()))
        return out

    monkeypatch.setattr(cluster, "cut", spy)
    assert cluster.cluster_bisect(df, block_rows=16).count() == len(rows)
    assert sum(vectors for _, vectors, _ in written) == 2
    rounds = [n for name, _, n in written if name == "centroids"]
    assert len(rounds) > 3 and max(rounds) <= 2


def test_rounds_send_a_cluster_a_bounded_number_of_times(spark):
    """However many tiles of ``max_rows`` a recording has; the nearest ones are those of all pairs, ties going to smaller numbers."""
    rng = np.random.default_rng(17)
    vectors = rng.normal(size=(120, 3)).round(0) + 0.5
    rows = [("a", 2 * i, 1.0, [float(x) for x in v], i % 4 > 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "recording_id string, cid bigint, n double, s array<double>, asks boolean")
    assert cluster._dealt(df, 4).count() <= 120 * (cluster.TILES + cluster.PARTS)
    dist = np.round(1 - vectors @ vectors.T, 9)
    np.fill_diagonal(dist, np.inf)
    want = {(2 * i, 2 * int(dist[i].argmin()), float(dist[i].min())) for i in range(120) if i % 4}
    for max_rows in (4, 16, 200):
        assert {(r.cid, r.other, r.dist) for r in cluster._nearest(df, max_rows).collect()} == want


def test_a_long_recording_takes_no_rounds_over_tables(spark, monkeypatch):
    """Rounds over tables are for what no task should hold: 5000 windows are merged in one, with the same labels."""
    df, _ = make(spark, [5000], d=4, seed=21, noise=0.5)
    rounds = labels(cluster.cluster_average_linkage(df, 4, max_rows=2500))
    written, keep = [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda table, name="cut": written.append(name) or keep(table, name))
    assert labels(cluster.cluster_average_linkage(df, 4)) == rounds
    assert written == []


def test_merging_holds_pieces_of_bounded_size():
    """Beside the vectors a task holds a piece of the distances, whatever the number of windows."""
    x = np.random.default_rng(4).normal(size=(6000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    try:
        merges = cluster.linkage_merges(x, np.ones(len(x)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(merges) == 5999
    assert peak < 40e6


def test_nearest_partners_in_pieces_are_those_of_all_distances(monkeypatch):
    """Ties, silent windows, a vector without numbers, sizes, and gaps that single precision can't tell."""
    monkeypatch.setattr(cluster._Asking, "ROWS", 7)
    monkeypatch.setattr(cluster._Asking, "COLUMNS", 16)
    rng = np.random.default_rng(13)
    base = rng.normal(size=(3, 5))
    for kind in range(4):
        s = base[rng.integers(0, 3, 90)] + rng.normal(size=(90, 5)) * (0, 3e-8, 1e-4, 0.5)[kind]
        s /= np.linalg.norm(s, axis=1, keepdims=True)
        if kind % 2:
            s[[4, 50]] = 0
            s[33] = np.nan
        n = rng.integers(1, 6, 90).astype(float)
        s *= n[:, None]
        cid = np.sort(rng.choice(500, 90, replace=False))
        dist = np.round(1 - np.einsum("ik,jk->ij", s, s) / np.outer(n, n), 9)
        dist[np.isnan(dist)] = cluster.FAR
        np.fill_diagonal(dist, np.inf)
        asks = rng.random(90) < 0.6
        asking = cluster._Asking(cid[asks], n[asks], s[asks])
        for part in np.array_split(rng.permutation(90), 3):
            asking.meet(cid[part], n[part], s[part])
        assert asking.other.tolist() == cid[dist.argmin(axis=1)][asks].tolist()
        assert asking.dist.tolist() == dist.min(axis=1)[asks].tolist()
