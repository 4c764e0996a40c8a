"""Speaker labels from window embeddings, and label sequences to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.params import BLOCK_ROWS, DEFAULTS

REC = ["recording_id"]
IDX = "win_idx"


def cosine_similarity(a: Column, b: Column) -> Column:
    """0.0 for a zero norm, unequal lengths or empty vectors."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def neighbour_similarity(windows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Similarity of each window to the one before it in its recording."""
    run = blocks.running(
        windows.select(*REC, IDX, "embedding"),
        REC,
        [IDX],
        blocks.block_of(IDX, block_rows),
        prevs={"_prev": F.col("embedding")},
    )
    return run.where(F.col("_prev").isNotNull()).select(
        *REC, IDX, cosine_similarity(F.col("embedding"), F.col("_prev")).alias("similarity")
    )


def standardise(windows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """z-scores per recording and feature: population deviation plus 1e-6."""
    feats = windows.select(*REC, F.posexplode("embedding").alias("f", "v"))
    stats = (
        feats.groupBy(*REC, "f")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        .groupBy(*REC)
        .agg(F.sort_array(F.collect_list(F.struct("f", "m", "s"))).alias("_st"))
    )
    rows = blocks.attach(windows, stats, REC, blocks.block_of(IDX, block_rows))
    scaled = F.zip_with("embedding", "_st", lambda v, t: (v - t["m"]) / (t["s"] + 1e-6))
    return rows.withColumn("embedding", scaled).drop("_st")


def fill_labels(windows: DataFrame, label: str = "raw_label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Windows without a label take the last one before them; a leading gap takes the first."""
    run = blocks.running(
        windows,
        REC,
        [IDX],
        blocks.block_of(IDX, block_rows),
        lasts={"_l": F.col(label)},
        total_firsts={"_f": F.col(label)},
    )
    return run.withColumn("label", F.coalesce("_l", "_f", F.lit(0))).drop("_l", "_f")


def majority_vote(windows: DataFrame, label: str = "label", k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred mode of ``k`` labels, ties to the smallest; the first and last k//2 stay as they are."""
    half = k // 2
    near = blocks.halo(windows, IDX, block_rows, half, half)
    w = blocks.halo_window(REC, IDX)
    edge = F.lag(IDX, half).over(w).isNull() | F.lead(IDX, half).over(w).isNull()
    voted = near.withColumns({"_e": edge, "_m": F.mode(label, True).over(w.rowsBetween(-half, half))})
    out = blocks.drop_halo(voted).withColumn(label, F.when(F.col("_e"), F.col(label)).otherwise(F.col("_m")))
    return out.drop("_m", "_e")


def median_filter(windows: DataFrame, label: str = "label", k: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred median over ``k`` labels with zeros beyond the ends.

    Without ``k``: the largest odd number up to 7 and the recording's length.
    """
    top = k or 7
    half = top // 2
    # Rows up to top - 1 away are in view, so a shorter recording is seen whole and its length known.
    near = blocks.halo(windows, IDX, block_rows, top - 1, top - 1)
    w = blocks.halo_window(REC, IDX)
    size = F.least(F.lit(top), F.count(F.lit(1)).over(w.rowsBetween(1 - top, top - 1)))
    at = F.struct(F.col(IDX).alias("i"), F.col(label).cast("long").alias("v"))
    framed = near.withColumns({"_n": size, "_f": F.collect_list(at).over(w.rowsBetween(-half, half))})
    framed = blocks.drop_halo(framed)
    odd = F.when(F.col("_n") % 2 == 0, F.greatest(F.lit(1), F.col("_n") - 1)).otherwise(F.col("_n"))
    framed = framed.withColumn("_w", F.lit(k) if k else odd).withColumn("_r", F.floor(F.col("_w") / 2))
    close = F.transform(F.filter("_f", lambda x: F.abs(x["i"] - F.col(IDX)) <= F.col("_r")), lambda x: x["v"])
    framed = framed.withColumn("_f", close)
    zeros = F.array_repeat(F.lit(0).cast("long"), (F.col("_w") - F.size("_f")).cast("int"))
    median = F.element_at(F.sort_array(F.concat("_f", zeros)), (F.col("_r") + 1).cast("int"))
    return framed.withColumn(label, median).drop("_f", "_n", "_w", "_r")


def smooth_labels(windows: DataFrame, label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Majority vote where a recording has more than two labels, else the three-wide median;
    fewer than three windows stay as they are."""
    kinds = windows.select(*REC, label).distinct().groupBy(*REC).agg((F.count(F.lit(1)) > 2).alias("_many"))
    rows = blocks.attach(windows, kinds, REC, blocks.block_of(IDX, block_rows)).withColumn("_v", F.col(label))
    near = blocks.halo(rows, IDX, block_rows, 2, 2)
    w = blocks.halo_window(REC, IDX)
    zero = F.lit(0).cast("long")
    before, after = F.lag("_v").over(w), F.lead("_v").over(w)
    trio = F.array(*[F.coalesce(c.cast("long"), zero) for c in (before, F.col("_v"), after)])
    framed = blocks.drop_halo(
        near.withColumns(
            {
                "_m": F.mode("_v", True).over(w.rowsBetween(-1, 1)),
                "_t": trio,
                "_e": F.lag(IDX).over(w).isNull() | F.lead(IDX).over(w).isNull(),
                "_s": F.count(F.lit(1)).over(w.rowsBetween(-2, 2)) < 3,
            }
        )
    )
    vote = F.when(F.col("_e"), F.col("_v")).otherwise(F.col("_m"))
    median = F.element_at(F.sort_array("_t"), 2)
    new = F.when(F.col("_s"), F.col("_v")).when(F.col("_many"), vote).otherwise(median)
    return framed.withColumn(label, new).drop("_m", "_t", "_e", "_s", "_v", "_many")


def gate_transitions(windows: DataFrame, hold: DataFrame, label: str = "raw_label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep the current speaker through loud windows.

    ``hold`` gives each recording's quiet limit. A window commits to its own
    label when it is quiet, or when it and the next up to three agree and one
    of them is quiet; others repeat the last committed label.
    """
    rows = blocks.attach(windows, hold.select(*REC, "hold"), REC, blocks.block_of(IDX, block_rows))
    near = blocks.halo(rows, IDX, block_rows, 0, 3)
    w = blocks.halo_window(REC, IDX).rowsBetween(0, 3)
    quiet = F.col("energy") < F.col("hold")
    agree = F.min(label).over(w) == F.max(label).over(w)
    hushed = F.min("energy").over(w) < F.col("hold")
    commit = (F.col(IDX) == 0) | quiet | (agree & hushed)
    marked = blocks.drop_halo(near.withColumn("_c", F.when(commit, F.col(label))))
    run = blocks.running(
        marked, REC, [IDX], blocks.block_of(IDX, block_rows), lasts={"label": F.col("_c")}
    )
    return run.drop("_c", "hold")


def labels_to_segments(
    windows: DataFrame,
    durations: DataFrame,
    step_seconds: float = DEFAULTS.step_seconds,
    half_window: float = 0.0,
    label: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Runs of equal labels as segments.

    A change at window i falls at i * step + ``half_window``; the first segment
    starts at 0 and the last ends with the recording (``duration_seconds``).
    """
    rows = windows.select(*REC, IDX, label)
    changes = blocks.islands(
        rows, REC, [IDX], blocks.block_of(IDX, block_rows), [label], lambda p, c, n: p[label] != c[label]
    ).where(F.col("idx") == F.col("island"))
    # One row per segment is left; its end is the next one's start.
    heads = blocks.running(
        changes.select(*REC, IDX, label),
        REC,
        [IDX],
        blocks.block_of(IDX, block_rows),
        prevs={"_p": F.col(IDX)},
        nexts={"_n": F.col(IDX)},
        sums={"_no": F.lit(1).cast("long")},
    )
    with_end = blocks.attach(heads, durations.select(*REC, "duration_seconds"), REC, blocks.block_of(IDX, block_rows))
    at = lambda c: F.col(c) * step_seconds + half_window
    return with_end.select(
        *REC,
        (F.col("_no") - 1).alias("seg_no"),
        F.format_string("SPEAKER_%02d", F.col(label).cast("long")).alias("speaker_id"),
        F.when(F.col("_p").isNull(), 0.0).otherwise(at(IDX)).alias("start_time"),
        F.coalesce(at("_n"), F.col("duration_seconds")).alias("end_time"),
    )
