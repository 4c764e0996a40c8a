"""Clustering of window embeddings into speakers, per recording.

Both operators work in rounds that are the same at every size. Average linkage
runs its rounds over tables while a recording has more than ``max_rows``
clusters, and the rest of them in one task, so that no task ever holds a
recording of unbounded length. The first rounds hold most of the comparing,
the many later ones little: over tables these would cost mostly their jobs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.params import BLOCK_ROWS, DEFAULTS
from voxloom.session import cut
from voxloom.sources.contracts import id_kind

REC = ["recording_id"]
IDX = "win_idx"
MAX_ROWS = 49_152  # clusters of a recording that one task merges to the end
TILES, PARTS = 8, 4  # of a recording, in a round over tables
TILE_ROWS = 4096  # clusters of a recording from which a round over tables cuts it into tiles
LABELS = "recording_id bigint, win_idx bigint, label bigint"


# --- two speakers: cosine k-means seeded along the first principal axis ---


def _leading_axis(scatter: np.ndarray) -> np.ndarray:
    """Main eigenvector; its largest component is made positive."""
    axis = np.linalg.eigh(scatter)[1][:, -1]
    return axis if axis[np.argmax(np.abs(axis))] > 0 else -axis


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def _unit(rows: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = rows.select(*REC, IDX, x.alias("_x")).withColumn("_norm", F.sqrt(_dot("_x", "_x")) + 1e-8)
    return rows.select(*REC, IDX, F.transform("_x", lambda v: v / F.col("_norm")).alias("unit"))


def _gram_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of a block: the vectors' total and their outer products."""
    u = np.vstack(pdf["unit"].to_numpy())
    rid = pdf["recording_id"].iloc[0]
    d = u.shape[1]
    values = np.concatenate([[len(u)], u.sum(axis=0), (u.T @ u).ravel()])
    return pd.DataFrame({"recording_id": rid, "cell": np.arange(1 + d + d * d), "v": values})


def _axis_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Principal axis from the summed cells of one recording (1 + d + d*d rows)."""
    v = pdf.sort_values("cell")["v"].to_numpy()
    d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
    n, total, gram = v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)
    axis = _leading_axis(gram - np.outer(total, total) / n)
    return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "axis": [axis.tolist()]})


def _side_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, recording and label: number and sum of the vectors, and whether a label moved."""
    for batch in batches:
        sizes = batch.column("unit").value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            recs = part.column("recording_id").dictionary_encode("encode")
            key = recs.indices.to_numpy() * 2 + part.column("label").to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            units = part.column("unit").flatten().to_numpy().reshape(len(key), int(size))[order]
            sums = np.add.reduceat(units, first, axis=0)
            moved = np.maximum.reduceat(part.column("moved").to_numpy()[order], first)
            n = np.diff(first, append=len(key))
            found = key[order][first]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * np.int32(size)), pa.array(sums.ravel()))
            columns = [recs.dictionary.take(pa.array(found // 2)), pa.array(found % 2), pa.array(n), vectors, pa.array(moved)]
            yield pa.RecordBatch.from_arrays(columns, names=["recording_id", "label", "n", "s", "moved"])


def _centroids(pdf: pd.DataFrame) -> pd.DataFrame:
    """Normalised mean vector of both labels of a recording, from partial sums."""
    centre: list = [None, None]
    for label, rows in pdf.groupby("label"):
        mean = np.vstack(rows["s"].to_numpy()).sum(axis=0) / rows["n"].sum()
        centre[int(label)] = (mean / (np.sqrt(mean @ mean) + 1e-8)).tolist()
    one = centre[0] is None or centre[1] is None
    return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[:1].to_numpy(), "moved": [bool(pdf["moved"].max())], "one": [one], "c0": [centre[0]], "c1": [centre[1]]})


def _nearer(c0: str, c1: str) -> Column:
    return F.coalesce((_dot("unit", c1) > _dot("unit", c0)).cast("bigint"), F.lit(0).cast("bigint"))


def cluster_bisect(windows: DataFrame, max_iter: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Label 0 or 1 per window: block sums for the axis, exact median, then rounds of assignment.

    A label follows from the centroids of its round, so a round writes those alone, one row per recording: it reads the
    windows once, tells whether labels moved between the last two sets of centroids and sums the vectors for the next. The
    windows are written twice, whatever the number of rounds. Recordings that are finished take no part in later rounds.
    """
    block = blocks.block_of(IDX, block_rows)
    unit = cut(_unit(windows), "unit")
    cells = unit.withColumn(blocks.BLK, block).groupBy(*REC, blocks.BLK).applyInPandas(
        _gram_block, id_kind(unit, "recording_id bigint, cell bigint, v double")
    )
    summed = cells.groupBy(*REC, "cell").agg(F.sum("v").alias("v"))
    axis = summed.groupBy(*REC).applyInPandas(_axis_of, id_kind(summed, "recording_id bigint, axis array<double>"))
    side = blocks.attach(unit, cut(axis, "axis"), REC, block).withColumn("side", _dot("unit", "axis")).drop("axis")
    side = cut(side, "side")
    middle = blocks.percentiles(side.select(*REC, "side"), REC, "side", {"median": 0.5}).select(*REC, "median")
    seeded = blocks.attach(side, cut(middle, "median"), REC, block).withColumn("seed", (F.col("side") > F.col("median")).cast("bigint"))

    def centred(rows: DataFrame) -> DataFrame:
        sums = rows.mapInArrow(_side_sums, id_kind(unit, "recording_id bigint, label bigint, n bigint, s array<double>, moved int"))
        return sums.groupBy(*REC).applyInPandas(_centroids, id_kind(unit, "recording_id bigint, moved boolean, one boolean, c0 array<double>, c1 array<double>"))

    now = cut(centred(seeded.select(*REC, "unit", F.col("seed").alias("label"), F.lit(1).alias("moved"))), "centroids")
    now = now.select(*REC, "c0", "c1")
    was = None
    finished: list[DataFrame] = []
    for _ in range(max_iter):
        both = now if was is None else now.join(was.select(*REC, F.col("c0").alias("b0"), F.col("c1").alias("b1")), REC)
        rows = blocks.attach(seeded, both, REC, block, "inner")
        before = F.col("seed") if was is None else _nearer("b0", "b1")
        rows = rows.select(*REC, "unit", _nearer("c0", "c1").alias("label"), before.alias("_b"))
        step = cut(centred(rows.select(*REC, "unit", "label", (F.col("label") != F.col("_b")).cast("int").alias("moved"))), "centroids")
        over = ~F.col("moved") | F.col("one")
        ended = step.where(over).select(*REC, F.col("moved").alias("_reset"))
        finished.append(now.join(ended, REC))
        was, now = now, step.where(~over).select(*REC, "c0", "c1")
        if not now.take(1):
            break
    else:
        finished.append(was.join(now.select(*REC), REC, "left_semi").withColumn("_reset", F.lit(False)))
    last = blocks.attach(seeded, cut(blocks.union_all(finished), "centroids"), REC, block, "inner")
    return last.select(*REC, IDX, F.when(F.col("_reset"), F.col("seed")).otherwise(_nearer("c0", "c1")).alias("label"))


# --- unknown number of speakers: average linkage over cosine distance ---
#
# For unit vectors the mean distance between two clusters is 1 - (Sa . Sb) / (na * nb)
# with the vector sums S, so a cluster is its size and its sum; no distance matrix is kept.


#
# One rule at every size: in each round all clusters merge that are each other's nearest partner. Of partners equally near
# the smallest number counts, distances are compared in steps of 1e-9 (sums of floats differ beyond that with the order of
# adding), and a merged cluster keeps the smaller number, which is that of its first window. Average linkage never brings a
# merged cluster closer to others than its parts were, so these are the merges of the closest pair each time, ties going to
# smaller numbers; for the same reason a cluster looks for a partner again only when it or its partner has merged.

DIGITS = 9


FAR = 1e9  # distance from a vector that holds no number


def _distances(s: np.ndarray, n: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    found = np.round(1.0 - (s @ others.T) / np.outer(n, sizes), DIGITS)
    found[np.isnan(found)] = FAR
    return found


class _Asking:
    """Clusters and the nearest partner of each that has come past; of equally near ones the smallest number.

    Mean vectors in single precision tell which partners can be the nearest, with room for their rounding; the distances of
    these few are taken from the sums. Where that leaves many, as with repeated vectors, all distances are taken.
    """

    ROWS, COLUMNS, FEW = 512, 2048, 32

    def __init__(self, cid: np.ndarray, n: np.ndarray, s: np.ndarray):
        self.cid, self.n, self.s = cid, n, s
        self.mean, self.length = self._means(n, s)
        self.dist, self.other = np.full(len(cid), np.inf), np.full(len(cid), -1)

    @staticmethod
    def _means(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s / n[:, None]
        return mean.astype(np.float32), np.sqrt((mean * mean).sum(axis=1))

    def meet(self, cid: np.ndarray, n: np.ndarray, s: np.ndarray) -> None:
        order = np.argsort(cid)
        for some in (order[at : at + self.COLUMNS] for at in range(0, len(order), self.COLUMNS)):
            others = (cid[some], n[some], s[some], *self._means(n[some], s[some]))
            for at in range(0, len(self.cid), self.ROWS):
                self._meet(slice(at, at + self.ROWS), *others)

    def _meet(self, rows: slice, cid: np.ndarray, n: np.ndarray, s: np.ndarray, mean: np.ndarray, length: np.ndarray) -> None:
        own = self.cid[rows]
        place = np.minimum(np.searchsorted(cid, own), len(cid) - 1)
        itself = np.flatnonzero(cid[place] == own)
        place = place[itself]
        like = self.mean[rows] @ mean.T
        like[itself, place] = -np.inf
        slack = 2 * (s.shape[1] + 8) * np.finfo(np.float32).eps * self.length[rows] * length.max() + 3 * 10.0**-DIGITS
        close = like >= (np.maximum(like.max(axis=1), 1.0 - self.dist[rows]) - slack)[:, None].astype(np.float32)
        close[itself, place] = False
        if np.isfinite(slack).all() and np.count_nonzero(close) <= self.FEW * len(own):
            row, col = np.nonzero(close)
            at = row + rows.start
            dist = np.round(1.0 - np.einsum("ij,ij->i", self.s[at], s[col]) / (self.n[at] * n[col]), DIGITS)
            order = np.lexsort((col, dist, row))
            first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            at, dist, other = at[first], dist[first], cid[col[first]]
        else:
            found = _distances(self.s[rows], self.n[rows], s, n)
            found[itself, place] = np.inf
            best = found.argmin(axis=1)
            at, dist, other = np.arange(len(own)) + rows.start, found[np.arange(len(own)), best], cid[best]
        nearer = (dist < self.dist[at]) | ((dist == self.dist[at]) & np.isfinite(dist) & (other < self.other[at]))
        self.dist[at[nearer]], self.other[at[nearer]] = dist[nearer], other[nearer]


def linkage_merges(sums: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """Average-linkage merges (kept, absorbed, height) of clusters in the order of their numbers, round by round."""
    s, n = sums.astype(np.float64).copy(), sizes.astype(np.float64).copy()
    near, dist = np.zeros(len(s), dtype=np.int64), np.full(len(s), np.inf)
    alive = np.arange(len(s))
    rows = alive
    merges: list[tuple[int, int, float]] = []
    while len(alive) > 1:
        asking = _Asking(rows, n[rows], s[rows])
        asking.meet(alive, n[alive], s[alive])
        near[rows], dist[rows] = asking.other, asking.dist
        lo = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(lo):  # rounding told two sides of a pair differently
            first = min(alive.tolist(), key=lambda i: (dist[i], min(i, near[i]), max(i, near[i])))
            lo = np.array([min(first, near[first])])
            near[lo] = max(first, near[first])
        hi = near[lo]
        merges += zip(lo.tolist(), hi.tolist(), np.minimum(dist[lo], dist[hi]).tolist())
        s[lo] += s[hi]
        n[lo] += n[hi]
        changed = np.zeros(len(s), dtype=bool)
        changed[lo] = changed[hi] = True
        alive = np.setdiff1d(alive, hi, assume_unique=True)
        rows = alive[changed[alive] | changed[near[alive]]]
    return merges


def linkage_labels(s: np.ndarray, n_clusters: int | None, threshold: float, max_clusters: int) -> np.ndarray:
    """Labels of unit vectors in the order of their numbers; the merges that ``_dropped_merges`` drops are left out."""
    merges = sorted(linkage_merges(s, np.ones(len(s))), key=lambda m: (m[2], -m[1]))
    if n_clusters is None:
        below = sum(h < threshold for _, _, h in merges)
        n_clusters = max(1, min(max_clusters, len(s) - below))
    top = np.arange(len(s))
    for lo, hi, _ in sorted(merges[: max(0, len(s) - n_clusters)], key=lambda m: m[1]):
        top[hi] = lo
    for i in range(len(s)):  # the kept number is the smaller one, so its own top is known
        top[i] = top[top[i]]
    return np.unique(top, return_inverse=True)[1].astype(np.int64)


def _nearest_past(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per tile, whose asking clusters come first: the best partner of each among the clusters that follow."""

    def out(rec: pa.Scalar, asking: _Asking) -> pa.RecordBatch:
        known = np.isfinite(asking.dist)
        recs = pa.array([rec.as_py()] * int(known.sum()), rec.type)
        columns = [recs, pa.array(asking.cid[known]), pa.array(asking.other[known]), pa.array(asking.dist[known])]
        return pa.RecordBatch.from_arrays(columns, names=["recording_id", "cid", "other", "dist"])

    key, own, asking = None, [], None
    for batch in batches:
        recs = batch.column("recording_id")
        keys = np.stack([recs.dictionary_encode().indices.to_numpy(), *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_i", "_j", "asks"))])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if batch.num_rows else []
        for at, end in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(at, end - at)
            cid, n = part.column("cid").to_numpy(), part.column("n").to_numpy()
            rows = (cid, n, part.column("s").flatten().to_numpy().reshape(len(cid), -1))
            tile = (recs[at].as_py(), keys[1, at], keys[2, at])
            if tile != key:
                if asking:
                    yield out(recording, asking)
                key, recording, own, asking = tile, recs[at], [], None
            if keys[3, at]:
                own.append(rows)
                continue
            if own and asking is None:
                asking = _Asking(*(np.concatenate(column) for column in zip(*own)))
            if asking:
                asking.meet(*rows)
    if asking:
        yield out(recording, asking)


def _dealt(clusters: DataFrame, tile_rows: int) -> DataFrame:
    """Clusters by tile (recording_id, _i, _j): those that ask are dealt once to ``_i``, all of them go past each ``_i``.

    A recording has at most ``TILES`` tiles ``_i`` until these reach 4 ``tile_rows`` clusters, and its clusters go past in up to
    ``PARTS`` parts ``_j``: until then a cluster is sent ``TILES + PARTS`` times at most.
    """
    few = lambda n, rows, most: F.least(F.ceil(n / rows), F.lit(most)).cast("int")
    asks, all_ = F.count_if("asks"), F.count(F.lit(1))
    count = clusters.groupBy(*REC).agg(
        F.greatest(few(asks, tile_rows, TILES), F.ceil(asks / (4 * tile_rows)).cast("int")).alias("_na"),
        few(all_, 4 * tile_rows, PARTS).alias("_nc"),
    ).where("_na > 0")
    rows = blocks.attach(clusters, count, REC, F.pmod(F.xxhash64("cid"), F.lit(64)), "inner")
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n, to: F.transform(F.sequence(F.lit(0), F.col(n) - 1), to)
    place = lambda asks, i, j: F.struct(F.lit(asks).alias("asks"), i.alias("_i"), j.alias("_j"))
    mine = every("_nc", lambda j: place(True, deal("_na"), j))
    past = every("_na", lambda i: place(False, i, deal("_nc")))
    places = F.explode(F.when(F.col("asks"), F.concat(mine, past)).otherwise(past)).alias("p")
    return rows.select(*REC, "cid", "n", "s", places).select(*REC, "cid", "n", "s", "p.*")


def _nearest(clusters: DataFrame, tile_rows: int) -> DataFrame:
    """(recording_id, cid, other, dist): the nearest partner of each cluster that asks.

    A task holds a tile of asking clusters while others of the recording stream past, and emits one row per asking cluster.
    """
    key = [*REC, "_i", "_j"]
    dealt = _dealt(clusters, tile_rows).repartition(*key).sortWithinPartitions(*key, F.desc("asks"))
    near = dealt.mapInArrow(_nearest_past, id_kind(clusters, "recording_id bigint, cid bigint, other bigint, dist double"))
    best = near.groupBy(*REC, "cid").agg(F.min(F.struct("dist", "other")).alias("b"))
    return best.select(*REC, "cid", F.col("b.other").alias("other"), F.col("b.dist").alias("dist"))


def _mutual(best: DataFrame) -> DataFrame:
    """(recording_id, cid, child, height) of clusters that are each other's nearest, cid < child."""
    back = best.select(*REC, F.col("cid").alias("other"), F.col("other").alias("cid"), F.col("dist").alias("_d"))
    both = best.join(back, [*REC, "cid", "other"]).where("cid < other")
    return both.select(*REC, "cid", F.col("other").alias("child"), F.least("dist", "_d").alias("height"))


def _merge_round(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters after the pairs have merged into their smaller number."""
    to = pairs.select(*REC, F.col("child").alias("cid"), F.col("cid").alias("into"))
    named = clusters.join(to, [*REC, "cid"], "left").select(*REC, F.coalesce("into", "cid").alias("cid"), "n", "s")
    both = named.groupBy(*REC, "cid").agg(F.sum("n").alias("n"), F.collect_list("s").alias("_s"))
    one, two = F.element_at("_s", 1), F.try_element_at("_s", F.lit(2))
    return both.select(*REC, "cid", "n", F.when(two.isNull(), one).otherwise(F.zip_with(one, two, lambda a, b: a + b)).alias("s"))


def _finish_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges among a recording's clusters (at most ``max_rows``) in one task."""
    pdf = pdf.sort_values("cid")
    cid = pdf["cid"].to_numpy()
    merges = linkage_merges(np.vstack(pdf["s"].to_numpy()), pdf["n"].to_numpy(float))
    return pd.DataFrame(
        {
            "recording_id": pdf["recording_id"].iloc[0],
            "cid": [cid[a] for a, _, _ in merges],
            "child": [cid[b] for _, b, _ in merges],
            "height": [h for _, _, h in merges],
        },
        columns=["recording_id", "cid", "child", "height"],
    )


def _by_recording(rows: DataFrame) -> GroupedData:
    """Rows grouped by recording, dealt over ranges by number of rows: large recordings do not share a task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *REC).groupBy(*REC)


def _dropped_merges(merges: DataFrame, n_clusters: int | None, threshold: float, max_clusters: int) -> DataFrame:
    """The highest merges, which are not performed: at most one less than the wanted clusters."""
    limit = (n_clusters if n_clusters is not None else max_clusters) - 1
    high = merges if n_clusters is not None else merges.where(F.col("height") >= threshold)
    # Two-stage top k, so that no recording's merges meet in one task.
    salted = blocks.Window.partitionBy(*REC, F.pmod(F.xxhash64("child"), F.lit(64))).orderBy(F.desc("height"), "child")
    whole = blocks.Window.partitionBy(*REC).orderBy(F.desc("height"), "child")
    top = high.withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= limit)
    return top.withColumn("_k", F.row_number().over(whole)).where(F.col("_k") <= limit).select(*REC, "child")


def follow_to_root(parents: DataFrame, keys: list[str]) -> DataFrame:
    """Follow (keys, cid, parent) to the top by doubling; a root is its own parent."""
    while True:
        up = parents.select(*keys, F.col("cid").alias("parent"), F.col("parent").alias("_gp"))
        step = cut(parents.join(up, [*keys, "parent"]).select(*keys, "cid", "parent", "_gp"), "roots")
        parents = step.select(*keys, "cid", F.col("_gp").alias("parent"))
        if not step.where("parent <> _gp").take(1):
            return parents


def cluster_average_linkage(
    windows: DataFrame,
    n_speakers: int | None = None,
    threshold: float = DEFAULTS.distance_threshold,
    max_speakers: int = DEFAULTS.max_speakers,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Speaker label per window, numbered by first appearance: recording_id, win_idx, label.

    Merges stop at ``n_speakers``, or where clusters are ``threshold`` or more apart, then at ``max_speakers``. Windows
    without an embedding are no points and get no row; a vector with NaN is farthest from all; repeated (recording, window) rows must not occur.
    """
    x = windows.where("embedding IS NOT NULL").select(*REC, F.col(IDX).cast("bigint").alias("cid"), F.transform("embedding", lambda v: v.cast("double")).alias("_x"))
    x = x.withColumn("_n", F.sqrt(_dot("_x", "_x")))
    unit = F.transform("_x", lambda v: v / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0))
    clusters = x.select(*REC, "cid", F.lit(1.0).alias("n"), unit.alias("s"))
    block = F.pmod(F.xxhash64("cid"), F.lit(64))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        label = linkage_labels(np.vstack(pdf["s"].to_numpy()), n_speakers, threshold, max_speakers)
        return pd.DataFrame({"recording_id": pdf["recording_id"], IDX: pdf["cid"], "label": label})

    many = clusters.groupBy(*REC).count().where(F.col("count") > max_rows).select(*REC)
    if not many.take(1):
        return _by_recording(clusters).applyInPandas(whole, id_kind(windows, LABELS))
    in_tasks = _by_recording(blocks.attach(clusters, many, REC, block, "left_anti")).applyInPandas(whole, id_kind(windows, LABELS))
    busy = cut(blocks.attach(clusters, many, REC, block, "left_semi"), "clusters")
    return in_tasks.unionByName(_linkage_rounds(busy, n_speakers, threshold, max_speakers, max_rows))


def _linkage_rounds(busy: DataFrame, n_speakers: int | None, threshold: float, max_speakers: int, max_rows: int) -> DataFrame:
    """Labels of recordings of more than ``max_rows`` windows: rounds over tables, the last ones in tasks."""
    block = F.pmod(F.xxhash64("cid"), F.lit(64))
    tile_rows = min(max_rows, TILE_ROWS)
    leaves = busy.select(*REC, "cid")
    small: list[DataFrame] = []
    merges: list[DataFrame] = []
    best = cut(_nearest(busy.withColumn("asks", F.lit(True)), tile_rows), "nearest")
    while True:
        pairs = cut(_mutual(best), "pairs")
        merges.append(pairs)
        busy = cut(_merge_round(busy, pairs), "clusters")
        many = cut(busy.groupBy(*REC).count().withColumn("many", F.col("count") > max_rows).drop("count"), "many")
        if not many.where("many").take(1):
            small.append(busy)
            break
        if many.where("not many").take(1):
            small.append(cut(blocks.attach(busy, many.where("not many"), REC, block, "left_semi"), "clusters"))
            busy = cut(blocks.attach(busy, many.where("many"), REC, block, "left_semi"), "clusters")
        moved = pairs.select(*REC, "cid").unionByName(pairs.select(*REC, F.col("child").alias("cid")))
        still = best.join(moved, [*REC, "cid"], "left_anti").join(moved.withColumnRenamed("cid", "other"), [*REC, "other"], "left_anti")
        still = still.select(*REC, "cid", "other", "dist").join(busy.select(*REC, "cid"), [*REC, "cid"], "left_semi")
        known = still.select(*REC, "cid", F.lit(False).alias("asks"))
        asking = busy.join(known, [*REC, "cid"], "left").withColumn("asks", F.coalesce("asks", F.lit(True)))
        best = cut(still.unionByName(_nearest(asking, tile_rows)), "nearest")
    last = _by_recording(blocks.union_all(small)).applyInPandas(_finish_group, id_kind(busy, "recording_id bigint, cid bigint, child bigint, height double"))
    tree = cut(blocks.union_all([*merges, last]), "tree")
    done = tree.join(_dropped_merges(tree, n_speakers, threshold, max_speakers), [*REC, "child"], "left_anti")
    up = done.select(*REC, F.col("child").alias("cid"), F.col("cid").alias("parent"))
    parents = leaves.join(up, [*REC, "cid"], "left").select(*REC, "cid", F.coalesce("parent", "cid").alias("parent"))
    roots = follow_to_root(cut(parents, "parents"), REC)
    # Clusters carry the number of their first window, so root order is order of first appearance.
    names = roots.where("cid = parent").select(*REC, "parent")
    names = names.withColumn("label", F.row_number().over(blocks.Window.partitionBy(*REC).orderBy("parent")) - 1)
    named = blocks.attach(roots, names, [*REC, "parent"], blocks.block_of("cid", BLOCK_ROWS))
    return named.select(*REC, F.col("cid").alias(IDX), F.col("label").cast("bigint").alias("label"))
