"""The most similar windows of each window, without a list of pairs.

Windows of a recording are cut into tiles, at most ``TILES`` of them until a tile has ``MOST_ROWS`` windows. A tile knows
its mean direction and the widest angle to it, and from a product with itself how similar the k-th best partner of each of
its windows is at least. As angles obey the triangle inequality, two tiles whose directions are too far apart cannot
improve on that, and never meet. A tile goes in pieces to those that it may meet, so a window is sent at most ``TILES``
times; a task keeps the best k of one tile's windows while the pieces of its partners stream past.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.params import BLOCK_ROWS
from voxloom.session import cut
from voxloom.sources.contracts import id_kind

REC = ["recording_id"]
SLACK = 1e-7  # of cosines, for rounding in the bounds
STEPS = 1e9  # similarities are compared in steps of 1 / STEPS, equal ones by window number
TILES = 16  # of a recording
MOST_ROWS = 8192  # of a tile
PIECE = 1024  # rows of a tile that are sent and multiplied together
NONE = np.iinfo(np.int64).max  # window number of a place without a partner
TILE = "recording_id bigint, size int, tile bigint, piece int, mean array<double>, spread double, floor double, idx binary, unit binary"
BEST = "recording_id bigint, win_idx bigint, rank int, other_idx bigint, similarity double"


class _Piece:
    """Windows of a tile and the best k partners of each that were met: by similarity, equal ones by window number."""

    def __init__(self, idx: np.ndarray, unit: np.ndarray, k: int):
        self.idx, self.unit, self.k = idx, unit, k
        self.sims, self.others = np.full((len(idx), k), -np.inf), np.full((len(idx), k), NONE)

    def meet(self, idx: np.ndarray, unit: np.ndarray) -> None:
        """Take the better ones of these partners. A window is no partner of its own; similarities count in steps."""
        raw = self.unit @ unit.T
        least = self.sims[:, -1:] - 2 / STEPS
        if raw.shape[1] > 4 * self.k and np.isinf(least).any():
            known = np.where(np.isnan(raw), -np.inf, raw)
            # one place more, as the window itself may be among them
            least = np.maximum(least, np.partition(known, -self.k - 1, axis=1)[:, [-self.k - 1]] - 2 / STEPS)
        row, col = np.nonzero(raw >= least)
        other = self.idx[row] != idx[col]
        row, col = row[other], col[other]
        if not len(row):
            return
        some, at = np.unique(row, return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(some)), self.k)])
        sims = np.concatenate([np.round(raw[row, col] * STEPS) / STEPS + 0.0, self.sims[some].ravel()])
        others = np.concatenate([idx[col], self.others[some].ravel()])
        order = np.lexsort((others, -sims, at))
        order = order[np.searchsorted(at[order], np.arange(len(some)))[:, None] + np.arange(self.k)]
        self.sims[some], self.others[some] = sims[order], others[order]


def _met_within(pieces: list[_Piece]) -> list[_Piece]:
    for own in pieces:
        for piece in pieces:
            own.meet(piece.idx, piece.unit)
    return pieces


def _tile(k: int):
    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("win_idx")
        idx = group.column("win_idx").to_numpy().astype(np.int64)
        size = group.column("size")[0].as_py()
        raw = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(idx), size)
        norm = np.sqrt((raw * raw).sum(1))
        unit = np.divide(raw, norm[:, None], out=np.zeros_like(raw), where=norm[:, None] > 0)
        mean = unit.sum(0)
        length = np.sqrt(mean @ mean)
        # a vector without direction is at 0 from everything: such a tile meets all
        loose = length == 0 or not norm.all()
        mean = np.zeros(size) if loose else mean / length
        spread = np.pi if loose else float(np.arccos(np.clip(unit @ mean, -1, 1)).max())
        pieces = _met_within([_Piece(idx[at : at + PIECE], unit[at : at + PIECE], k) for at in range(0, len(idx), PIECE)])
        floor = float(min(p.sims[:, -1].min() for p in pieces))
        rec, tile, n = group.column("recording_id")[0].as_py(), group.column("tile")[0].as_py(), len(pieces)
        columns = [[rec] * n, [size] * n, [tile] * n, range(n), [mean.tolist()] + [None] * (n - 1), [spread] * n, [floor] * n, [p.idx.tobytes() for p in pieces], [p.unit.tobytes() for p in pieces]]
        kinds = [group.schema.field("recording_id").type, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
        names = [part.split()[0] for part in TILE.split(", ")]
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=names)

    return work


def _stream(k: int):
    """Rows of one tile come together, its own pieces first; those of its partners follow one by one."""

    def out(rec: pa.Scalar, own: list[_Piece]) -> Iterator[pa.RecordBatch]:
        for piece in own:
            row, place = np.nonzero(np.isfinite(piece.sims))
            columns = [pa.array([rec.as_py()] * len(row), rec.type), piece.idx[row], (place + 1).astype(np.int32), piece.others[row, place], piece.sims[row, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["recording_id", "win_idx", "rank", "other_idx", "similarity"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, own, within = None, [], False
        for batch in batches:
            columns = [batch.column(c) for c in ("recording_id", "size", "partner", "piece", "idx", "unit")]
            for rec, size, partner, piece, idx, unit in zip(*columns, strict=True):
                idx = np.frombuffer(idx.as_py(), np.int64)
                unit = np.frombuffer(unit.as_py(), np.float64).reshape(len(idx), size.as_py())
                if partner.as_py() is None:
                    if piece.as_py() == 0:
                        if own:
                            yield from out(whose, own if within else _met_within(own))
                        whose, own, within = rec, [], False
                    own.append(_Piece(idx, unit, k))
                    continue
                if not within:
                    within = bool(_met_within(own))
                for mine in own:
                    mine.meet(idx, unit)
        if own:
            yield from out(whose, own if within else _met_within(own))

    return work


def tiled(rows: DataFrame, tile_rows: int) -> DataFrame:
    """Adds ``tile``: ``tile_rows`` numbers each, and as many of these together as leave ``TILES`` tiles or reach ``MOST_ROWS`` windows."""
    key = [*REC, "size", "_part"]
    rows = rows.withColumn("_part", F.floor(F.col("win_idx") / tile_rows).cast("long"))
    parts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    parts = blocks.running(parts, key[:-1], ["_part"], blocks.block_of("_part", BLOCK_ROWS), sums={"_upto": F.col("_n")}, total_sums={"_all": F.col("_n")})
    width = F.greatest(F.lit(tile_rows), F.least(F.lit(MOST_ROWS), F.ceil(F.col("_all") / TILES)))
    tile = F.floor((F.col("_upto") - F.col("_n")) / width).cast("long")
    parts = parts.select(*[F.col(c).alias(f"_of_{c}") for c in key], tile.alias("tile"))
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(parts, same).select(*rows.drop("_part").columns, "tile")


def meeting(tiles: DataFrame) -> DataFrame:
    """Tiles and those of the same recording that may hold a better partner: recording_id, size, tile, partner."""
    left = tiles.select(*REC, "size", "tile", "mean", "spread", "floor")
    right = tiles.select(F.col("recording_id").alias("_rec"), F.col("size").alias("_size"), F.col("tile").alias("partner"), F.col("mean").alias("_mean"), F.col("spread").alias("_spread"))
    dot = F.aggregate(F.zip_with("mean", "_mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("spread") - F.col("_spread")
    reach = F.cos(F.greatest(F.lit(0.0), gap)) + SLACK >= F.col("floor")
    same = F.col("recording_id").eqNullSafe(F.col("_rec")) & (F.col("size") == F.col("_size")) & (F.col("tile") != F.col("partner"))
    return left.join(right, same & reach).select(*REC, "size", "tile", "partner")


def similar_windows(windows: DataFrame, k: int = 5, tile_rows: int = 512) -> DataFrame:
    """Rows recording_id, win_idx, rank (from 1), other_idx, similarity: the ``k`` windows of the same recording with the
    highest cosine similarity to each window, all others if there are fewer; equal ones by number.

    Every window is compared, or proven too far by its tile. Zero vectors are at 0 from all. Only vectors of one length
    compare; windows without a vector, or with nulls in it, neither get rows nor are partners. Window numbers are unique in
    a recording. A tile has at least ``tile_rows`` numbers; a task holds one tile, a piece of another and the product of two pieces.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    rows = windows.where(usable).select(*REC, "win_idx", F.size("embedding").alias("size"), "embedding")
    tiles = cut(tiled(rows, tile_rows).groupBy(*REC, "size", "tile").applyInArrow(_tile(k), id_kind(rows, TILE)), "tiles")

    pairs = meeting(tiles.where("piece = 0"))
    held = tiles.select(F.col("recording_id").alias("_rec"), F.col("size").alias("_size"), F.col("tile").alias("_tile"), "piece", "idx", "unit")
    match = F.col("recording_id").eqNullSafe(F.col("_rec")) & (F.col("size") == F.col("_size")) & (F.col("partner") == F.col("_tile"))
    sent = pairs.join(held, match).select(*REC, "size", "tile", "partner", "piece", "idx", "unit")
    own = tiles.select(*REC, "size", "tile", F.lit(None).cast("long").alias("partner"), "piece", "idx", "unit")
    key = [*REC, "size", "tile"]
    dealt = own.unionByName(sent).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("partner"), "piece")
    return dealt.mapInArrow(_stream(k), id_kind(rows, BEST))
