"""Order-dependent operators that never gather one key in one task.

A window partitioned by recording alone puts a whole recording in one task,
so a single recording that holds a third of the rows decides the run time.
Here every key is cut into *blocks*: any column that never decreases along the
key's order (position // n, time // seconds). Windows run per (key, block),
each block is reduced to one summary row, the carry between blocks is computed
on the summaries, and it is joined back on (key, block).

The block rows and their summaries read the same shuffle: both start at one
``repartition(keys, block)``, and the summaries hash every column so that both
ask for the same ones (``PIN``) and Spark reuses the exchange. Callers select
the columns they need beforehand. No row is lost: null keys are one key, and
rows with a null block are a block of their own, where nulls sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import cut

BLK = "_blk"
PIN = "_pin"
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def block_of(position: Column | str, width: float) -> Column:
    """Block number of a position (or time) column."""
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(width)).cast("long")


def _null_safe(block: Column, last: bool = False) -> Column:
    """The block, or for null the least (``last``: the greatest) number."""
    return F.coalesce(block.cast("long"), F.lit(2**63 - 1 if last else -(2**63)).cast("long"))


def _blocked(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """The rows dealt by key and block, and the columns to use as keys: structs where a key may be null, as these
    are equal if both hold null and so need no null-safe join, which would ask for another shuffle."""
    rows = df.withColumn(BLK, _null_safe(block, _descending(order)))
    names = [f"_key{i}" if df.schema[c].nullable else c for i, c in enumerate(keys)]
    rows = rows.withColumns({n: F.struct(c) for n, c in zip(names, keys) if n != c})
    return rows.repartition(*names, BLK), names


def _pin(base: DataFrame) -> Column:
    return F.max(F.xxhash64(*base.columns)).alias(PIN)


def _win(keys: Sequence[str], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys, BLK).orderBy(*order)


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _rejoin(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return local.join(carry.where(F.col(PIN).isNotNull()).drop(PIN), [*keys, BLK])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    prevs: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    total_sums: Mapping[str, Column] | None = None,
    total_maxes: Mapping[str, Column] | None = None,
    total_firsts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running values along each key, inclusive of the current row.

    ``sums``/``maxes`` accumulate, ``lasts`` is the latest non-null value,
    ``prevs``/``nexts`` look one row back or ahead, ``total_*`` are values of
    the whole key (``total_firsts``: its first non-null value).
    """
    sums, lasts, maxes = dict(sums or {}), dict(lasts or {}), dict(maxes or {})
    prevs, nexts = dict(prevs or {}), dict(nexts or {})
    t_sums, t_maxes, t_firsts = dict(total_sums or {}), dict(total_maxes or {}), dict(total_firsts or {})
    order = _cols(order)
    base, keys = _blocked(df, keys, block, order)
    w = _win(keys, order)
    here = w.rowsBetween(*UP_TO_HERE)

    exprs = {}
    for name, e in sums.items():
        exprs[f"_x_{name}"] = F.coalesce(F.sum(e).over(here), F.lit(0))
    for name, e in lasts.items():
        exprs[f"_x_{name}"] = F.last(e, ignorenulls=True).over(here)
    for name, e in maxes.items():
        exprs[f"_x_{name}"] = F.max(e).over(here)
    # One-field structs keep "no neighbour in this block" apart from "neighbour is null".
    for name, e in prevs.items():
        exprs[f"_x_{name}"] = F.lag(F.struct(e.alias("v"))).over(w)
    for name, e in nexts.items():
        exprs[f"_x_{name}"] = F.lead(F.struct(e.alias("v"))).over(w)

    local = base.withColumns(exprs) if exprs else base

    pos = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(_plain(order))])
    desc = _descending(order)
    first_by = (lambda e, o: F.max_by(e, o)) if desc else (lambda e, o: F.min_by(e, o))
    last_by = (lambda e, o: F.min_by(e, o)) if desc else (lambda e, o: F.max_by(e, o))
    aggs = []
    for name, e in {**sums, **{f"t_{k}": v for k, v in t_sums.items()}}.items():
        aggs.append(F.sum(e).alias(f"_s_{name}"))
    for name, e in {**maxes, **{f"t_{k}": v for k, v in t_maxes.items()}}.items():
        aggs.append(F.max(e).alias(f"_s_{name}"))
    for name, e in lasts.items():
        aggs.append(last_by(e, F.when(e.isNotNull(), pos)).alias(f"_s_{name}"))
    for name, e in prevs.items():
        aggs.append(last_by(F.struct(e.alias("v")), pos).alias(f"_s_{name}"))
    for name, e in nexts.items():
        aggs.append(first_by(F.struct(e.alias("v")), pos).alias(f"_s_{name}"))
    for name, e in t_firsts.items():
        aggs.append(first_by(e, F.when(e.isNotNull(), pos)).alias(f"_s_t_{name}"))
    summary = base.groupBy(*keys, BLK).agg(*aggs, _pin(base))

    wk = Window.partitionBy(*keys).orderBy(BLK)
    before, whole = wk.rowsBetween(*BEFORE), wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    picks = []
    for name in sums:
        picks.append(F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_c_{name}"))
    for name in lasts:
        picks.append(F.last(f"_s_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
    for name in maxes:
        picks.append(F.max(f"_s_{name}").over(before).alias(f"_c_{name}"))
    for name in prevs:
        picks.append(F.lag(f"_s_{name}").over(wk).alias(f"_c_{name}"))
    for name in nexts:
        picks.append(F.lead(f"_s_{name}").over(wk).alias(f"_c_{name}"))
    for name in t_sums:
        picks.append(F.sum(f"_s_t_{name}").over(whole).alias(name))
    for name in t_maxes:
        picks.append(F.max(f"_s_t_{name}").over(whole).alias(name))
    for name in t_firsts:
        picks.append(F.first(f"_s_t_{name}", ignorenulls=True).over(whole).alias(name))
    carry = summary.select(*keys, BLK, PIN, *picks)

    out = _rejoin(local, carry, keys)
    final = {}
    for name in sums:
        final[name] = F.col(f"_x_{name}") + F.col(f"_c_{name}")
    for name in lasts:
        final[name] = F.coalesce(F.col(f"_x_{name}"), F.col(f"_c_{name}"))
    for name in maxes:
        final[name] = F.greatest(F.col(f"_x_{name}"), F.col(f"_c_{name}"))
    for name in [*prevs, *nexts]:
        final[name] = F.coalesce(F.col(f"_x_{name}"), F.col(f"_c_{name}")).getField("v")
    keep = [c for c in df.columns if c not in final]
    return out.select(*keep, *[e.alias(n) for n, e in final.items()], *t_sums, *t_maxes, *t_firsts)


def _descending(order: Sequence[Column]) -> bool:
    flags = {" DESC" in str(o) for o in order}
    if len(flags) > 1:
        raise ValueError("order columns must all ascend or all descend")
    return flags.pop()


def _plain(order: Sequence[Column]) -> list[Column]:
    """Sort columns without their direction, usable inside a struct."""
    out = []
    for o in order:
        text = str(o)
        out.append(F.expr(text[len("Column<'"):].split(" DESC")[0]) if " DESC" in text else o)
    return out


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column, name: str = "row_no"
) -> DataFrame:
    """1-based row number along each key."""
    return running(df, keys, order, block, sums={name: F.lit(1).cast("long")})


def short_row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "row_no", few: int = 4096
) -> DataFrame:
    """``row_numbers`` where nearly all keys have few rows: these cost one shuffle of the rows and no summaries.

    Keys of more than ``few`` rows, found by counting, are numbered by blocks as ever.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    long = cut(counts.where(F.col("_c") > few).select(*keys), "long")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if not long.take(1):
        return df.withColumn(name, number)
    rest = _met(df, long, keys, "left_anti").withColumn(name, number)
    return rest.unionByName(row_numbers(_met(df, long, keys, "left_semi"), keys, order, block, name))


def range_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], descending: bool = False
) -> DataFrame:
    """Running sums along each key, inclusive, where no column bounds the size of a block.

    The rows are dealt into ranges of (keys, order) whose limits Spark samples, so that a key with a third of all rows, or
    all of them, spreads over many ranges however close its rows lie. The ranges are written once, since sampled limits may
    differ when a stage runs again; each (range, key) then gives one row of sums, and the sums before it are its carry.
    ``order`` should tell the rows of a key apart: rows equal in it share a range and come in any order.
    """
    part = "_range"
    by = [F.col(c).desc() if descending else F.col(c) for c in order]
    spread = df.repartitionByRange(*keys, *by).withColumn(part, F.spark_partition_id())
    names = [f"_in_{n}" for n in sums]
    rows = cut(spread.withColumns(dict(zip(names, sums.values()))), "ranges")
    # Structs hold null keys, which are equal as such.
    rows = rows.withColumn("_key", F.struct(F.lit(0).alias("one"), *keys)).repartition("_key", part)
    local = Window.partitionBy("_key", part).orderBy(*by).rowsBetween(*UP_TO_HERE)
    before = Window.partitionBy("_key").orderBy(part).rowsBetween(*BEFORE)
    carry = rows.groupBy("_key", part).agg(*[F.sum(c).alias(f"_of{c}") for c in names])
    carry = carry.select("_key", part, *[F.coalesce(F.sum(f"_of{c}").over(before), F.lit(0)).alias(f"_to{c}") for c in names])
    out = rows.withColumns({f"_at{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in names}).join(carry, ["_key", part])
    return out.select(*df.columns, *[(F.col(f"_at{c}") + F.col(f"_to{c}")).alias(n) for n, c in zip(sums, names)])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    cols: Sequence[str],
    start: Callable[[Column, Column, Column], Column],
) -> DataFrame:
    """Gaps and islands: adds ``idx`` (0-based place in the key), ``island``
    (``idx`` of the island's first row), ``prev`` and ``next`` (structs of ``cols``).

    ``start(prev, cur, next)`` says whether a row opens an island; a key's
    first row always does. ``next`` is null on a key's last row.
    """
    order = _cols(order)
    base, keys = _blocked(df, keys, block, order)
    w = _win(keys, order)
    cur = F.struct(*cols)

    def opens(p: Column, c: Column, n: Column) -> Column:
        return p.isNull() | F.coalesce(start(p, c, n), F.lit(False))

    rn, n = F.col("_rn"), F.col("_n")
    no_prev, no_next = F.col("_prev").isNull(), F.col("_next").isNull()
    local = base.withColumn("_cur", cur).withColumns(
        {"_rn": F.row_number().over(w), "_prev": F.lag("_cur").over(w), "_next": F.lead("_cur").over(w)}
    )
    # Only a block's edge rows and the rows that surely open an island reach the summary.
    inner = ~no_prev & ~no_next & opens(F.col("_prev"), F.col("_cur"), F.col("_next"))
    summary = (
        local.where(no_prev | no_next | inner)
        .groupBy(*keys, BLK)
        .agg(
            F.max("_rn").alias("_n"),
            F.max_by(F.struct("_cur", "_next"), F.when(no_prev, 1)).alias("_first"),
            F.max_by(F.struct("_prev", "_cur"), F.when(no_next, 1)).alias("_last"),
            F.max(F.when(inner, rn)).alias("_in"),
            _pin(base),
        )
    )
    wk = Window.partitionBy(*keys).orderBy(BLK)
    edges = summary.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(wk.rowsBetween(*BEFORE)), F.lit(0)),
            "_pl": F.lag("_last._cur").over(wk),
            "_nf": F.lead("_first._cur").over(wk),
        }
    )
    first_opens = opens(F.col("_pl"), F.col("_first._cur"), F.coalesce("_first._next", "_nf"))
    last_opens = (n > 1) & opens(F.col("_last._prev"), F.col("_last._cur"), F.col("_nf"))
    edges = edges.withColumn(
        "_open",
        F.col("_before") + F.coalesce(F.when(last_opens, n), F.col("_in"), F.when(first_opens, F.lit(1))) - 1,
    )
    carry = edges.select(
        *keys,
        BLK,
        PIN,
        "_before",
        "_pl",
        "_nf",
        F.last("_open", ignorenulls=True).over(wk.rowsBetween(*BEFORE)).alias("_carry"),
    )
    out = _rejoin(local, carry, keys).withColumns(
        {
            "idx": F.col("_before") + rn - 1,
            "prev": F.coalesce("_prev", "_pl"),
            "next": F.coalesce("_next", "_nf"),
        }
    )
    opened = F.when(opens(F.col("prev"), F.col("_cur"), F.col("next")), F.col("idx"))
    out = out.withColumn(
        "island",
        F.coalesce(F.max(opened).over(w.rowsBetween(*UP_TO_HERE)), F.col("_carry")),
    )
    return out.select(*df.columns, "idx", "island", "prev", "next")


def halo(df: DataFrame, idx: str, width: int, before: int, after: int) -> DataFrame:
    """Copy the rows near a block edge into the neighbouring block.

    With dense ``idx`` a frame of ``before``/``after`` rows can then be taken
    per (key, block); rows with ``_own`` false are the copies, to be dropped.
    """
    lo = F.greatest(F.lit(0), F.floor((F.col(idx) - after) / width))
    hi = F.floor((F.col(idx) + before) / width)
    return df.withColumn(BLK, F.explode(F.sequence(lo.cast("long"), hi.cast("long")))).withColumn(
        "_own", F.floor(F.col(idx) / width) == F.col(BLK)
    )


def halo_window(keys: Sequence[str], idx: str) -> Window:
    return Window.partitionBy(*keys, BLK).orderBy(idx)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop(BLK, "_own")


def attach(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], block: Column, how: str = "left"
) -> DataFrame:
    """Join one-row-per-key ``stats`` to rows without a hot join key.

    ``how`` is left, inner, left_semi or left_anti. The stats are first joined
    to the distinct (key, block) pairs, then to the rows on both columns. Rows
    with a null block are a block too; a null key meets nothing, as in SQL.
    """
    rows = df.withColumn(BLK, _null_safe(block))
    pairs = rows.select(*keys, BLK).distinct()
    if how in ("left_semi", "left_anti"):
        hits = pairs.join(stats.select(*keys), list(keys), "left_semi")
    else:
        hits = pairs.join(stats, list(keys), "inner")
    return rows.join(hits, [*keys, BLK], how).drop(BLK)


def nest_pages(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    item: Column,
    page_rows: int,
    name: str = "items",
) -> DataFrame:
    """Nest rows into arrays of at most ``page_rows`` items: (keys, page_no, name).

    A key's pages, read in order, hold all of its rows; most keys have one page.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(
        *keys, *[o.alias(n) for o, n in zip(_cols(order), names)], block.alias("_page_blk"), item.alias("_item")
    )
    numbered = row_numbers(rows, keys, names, F.col("_page_blk"), "_no")
    page = F.floor((F.col("_no") - 1) / page_rows).cast("long")
    nested = numbered.groupBy(*keys, page.alias("page_no")).agg(
        F.sort_array(F.collect_list(F.struct("_no", "_item"))).alias("_l")
    )
    return nested.select(*keys, "page_no", F.transform("_l", lambda x: x["_item"]).alias(name))


def _digits(v: Column) -> Column:
    """A whole number that never falls as ``v`` grows: the logarithm of its size in 1 966 080 steps an octave, signed."""
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1024.0)) + 1100) * (30 * 65536))
    return F.when(v > 0, size + 1).when(v < 0, -1 - size).otherwise(F.lit(0)).cast("long")


def _met(rows: DataFrame, found: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``on``, where null meets null."""
    other = found.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return rows.join(other, same, how).drop(*[f"_r_{c}" for c in on])


def _before(counts: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Adds ``_from`` and ``_under``: count and sum of the smaller entries of the same ``within``."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c, none: F.coalesce(F.sum(c).over(w), F.lit(none))
    return counts.withColumns({"_from": first("_c", 0), "_under": first("_s", 0.0)})


_HIT = "_from <= _r AND _r < _from + _c"


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact order statistics per key, without ordering the rows.

    ``ranks`` gives 0-based ranks within 0 to n - 1 as functions of the key's row count. Columns: keys, ``n``, ``sum``,
    and for each name the value at its rank and ``<name>_below``, the sum of the values at smaller ranks.

    Radix selection: a histogram by the upper digits of each value's size (at most 130 000 buckets a key, whatever the
    rows) says which bucket holds a rank. Rows of these buckets alone are counted by the lower digits, and of those only
    what shares all digits with a wanted rank is put in order, equal values counted as one. Nulls don't count; null keys
    are one key.
    """
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, v.alias("_v"), _digits(v).alias("_f"))
    rows = rows.withColumn("_b", F.shiftright("_f", 16))
    counted = [F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s")]
    all_of = Window.partitionBy(*keys)
    wide = _before(rows.groupBy(*keys, "_b").agg(*counted), keys, "_b")
    wide = wide.withColumns({"n": F.sum("_c").over(all_of), "sum": F.sum("_s").over(all_of)})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("r")) for name, rank in ranks.items()])
    wide = wide.withColumn("_w", F.explode(wanted)).withColumn("_r", F.col("_w.r")).where(_HIT)
    wide = cut(wide.select(*keys, "_b", "n", "sum", F.col("_w.name").alias("_name"), (F.col("_r") - F.col("_from")).alias("_r"), F.col("_under").alias("_u")), "digits")

    near = cut(_met(rows, wide.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi"), "near")
    fine = _before(near.groupBy(*keys, "_b", "_f").agg(*counted), [*keys, "_b"], "_f")
    fine = _met(fine, wide, [*keys, "_b"]).where(_HIT).drop("_c", "_s", "_b")
    fine = fine.withColumns({"_r": F.col("_r") - F.col("_from"), "_u": F.col("_u") + F.col("_under")}).drop("_from", "_under")

    last = near.groupBy(*keys, "_f", "_v").agg(*counted)
    last = _met(last, fine.select(*keys, "_f").distinct(), [*keys, "_f"], "left_semi")
    last = _met(_before(last, [*keys, "_f"], "_v"), fine, [*keys, "_f"]).where(_HIT)
    below = F.col("_u") + F.col("_under") + F.col("_v") * (F.col("_r") - F.col("_from"))
    picked = [F.max(F.when(F.col("_name") == name, c)).alias(f"{name}{end}") for name in ranks for c, end in ((F.col("_v"), ""), (below, "_below"))]
    return last.groupBy(*keys).agg(F.max("n").alias("n"), F.max("sum").alias("sum"), *picked)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated percentiles (fractions) per key, and the row count ``n``."""
    low = {name: lambda n, q=q: F.floor((n - 1) * F.lit(float(q))) for name, q in wanted.items()}
    high = {f"{name}_b": lambda n, q=q: F.least(F.floor((n - 1) * F.lit(float(q))) + 1, n - 1) for name, q in wanted.items()}
    at = select_ranks(df, keys, value, low | high)
    share = lambda q: (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
    return at.select(*keys, *[(F.col(p) + (F.col(f"{p}_b") - F.col(p)) * share(q)).alias(p) for p, q in wanted.items()], "n")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
