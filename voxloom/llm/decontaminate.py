"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks (operator 3); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, boxed, row_key, unboxed, written

BITS = 64


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; null as none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(column: str, size: int) -> Column:
    """Hashes of all sequences of ``size`` words of an array column, by place; none if it has fewer."""
    last = F.size(column) - size

    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(column), i + k) for k in range(size)])

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def simhash(grams: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint ``fp`` per key of a table with one row per shingle: a bit is set if more than half have it."""
    total = F.count("*")
    ones = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))) for b in range(BITS)]
    bits = [F.when(2 * one > total, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b, one in enumerate(ones)]
    fp = bits[0]
    for bit in bits[1:]:
        fp = fp.bitwiseOR(bit)
    return grams.groupBy(*keys).agg(fp.alias("fp"), total.alias("n_grams"))


def block_layout(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks: fingerprints within the radius agree on at least one."""
    count, shift, out = radius + 1, 0, []
    for k in range(count):
        width = BITS // count + (k < BITS % count)
        out.append((shift, width))
        shift += width
    return out


def _block(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _with_blocks(df: DataFrame, layout: list[tuple[int, int]], name: str) -> DataFrame:
    cells = [F.struct(F.lit(k).alias("block"), _block(F.col("fp"), s, w).alias("value")) for k, (s, w) in enumerate(layout)]
    return df.withColumn(name, F.explode(F.array(*cells)))


def contaminated_windows(
    docs: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 18,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows doc_id, item_id, start, n_words, distance, similarity: windows of a document as long as an item whose weighted
    shingles agree with the item's to ``least`` or more (sum of smaller counts over sum of larger).

    A window that similar holds at least a bound of shingles that occur in its item, wherever they stand, so every start
    is laid whose window holds that many: for shared shingles at sorted places p, from p[i + bound - 1] - (window - 1)
    to p[i]. Fingerprints of windows and items are cut into radius + 1 blocks; equal blocks of equal lengths give every
    pair within the radius, and those are verified. With 64 bits a similarity of 0.8 differs in under ten bits on
    average and in more than 18 about once in a thousand.

    Items of fewer than ``shingle`` words (null and empty ones too) and documents without words match nothing. Rows
    equal in id and text are reported once; null ids are kept.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("_text"))
    known = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w"))
    known = known.where(F.size("w") >= shingle).select("item_id", F.size("w").alias("n_words"), shingles("w", shingle).alias("grams"))
    known = known.withColumn("item_key", F.xxhash64("item_id", "grams")).dropDuplicates(["item_id", "item_key"])
    item_grams = written(known.select("item_id", "item_key", "n_words", F.posexplode("grams").alias("q", "h")), "item_grams")
    seeds = item_grams.select(F.col("h").alias("_h"), "item_id", "item_key", "n_words").distinct()

    tokens = own.select("doc_id", "key", words(F.col("_text")).alias("w"))
    places = tokens.select("doc_id", "key", F.size("w").alias("size"), F.posexplode(shingles("w", shingle)).alias("p", "h"))
    met = places.join(bounded(seeds, item_grams.count()), F.col("h") == F.col("_h"))
    shared = met.groupBy("doc_id", "key", "size", "item_id", "item_key", "n_words").agg(F.sort_array(F.collect_set("p")).alias("at"))
    # the shingles of a window and of the item, and how many the window must share at least
    full, held = F.col("n_words") - (shingle - 1), F.least("n_words", "size") - (shingle - 1)
    bound = F.greatest(F.lit(1), F.ceil((full + held) * (least / (1 + least)) - 1e-6)).cast("int")
    shared = shared.withColumns({"held": held, "bound": bound, "latest": F.greatest(F.lit(0), F.col("size") - F.col("n_words"))})

    def starts(i: Column) -> Column:
        """Starts of the windows that hold ``bound`` places from the i-th on, without those laid for the place before."""
        after = F.coalesce(F.get("at", i - 1), F.lit(-1)) + 1
        low = F.greatest(after, F.get("at", i + F.col("bound") - 1) - F.col("held") + 1)
        high = F.least(F.get("at", i), F.col("latest"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    laid = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("bound")), starts))
    shared = shared.where(F.size("at") >= F.col("bound")).select("doc_id", "key", "n_words", F.explode(laid).alias("start"))
    windows = written(shared.select("doc_id", "key", "start", "n_words").distinct(), "windows")

    touched = windows.select("doc_id", "key").distinct()
    touched = bounded(touched.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")), windows.count())
    hit = own.join(touched, (own["key"] == touched["_k"]) & own["doc_id"].eqNullSafe(touched["_d"]), "left_semi").dropDuplicates(["doc_id", "key"])
    hit = hit.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), words(F.col("_text")).alias("w"))
    hit = hit.select("_d", "_k", shingles("w", shingle).alias("grams"))
    laid = windows.join(hit, (windows["key"] == hit["_k"]) & windows["doc_id"].eqNullSafe(hit["_d"]))
    inside = F.slice("grams", F.col("start") + 1, F.col("n_words") - shingle + 1)
    ids = ["doc_id", "key", "start", "n_words"]
    grams = written(laid.select(*ids, F.explode(inside).alias("h")), "grams")

    layout = block_layout(radius)
    asked = _with_blocks(simhash(grams, ids), layout, "cell").select(*ids, "fp", "n_grams", F.col("cell.block").alias("block"), F.col("cell.value").alias("value"))
    held = _with_blocks(simhash(item_grams, ["item_id", "item_key", "n_words"]), layout, "cell").select(
        "item_id", "item_key", F.col("n_words").alias("_n"), F.col("fp").alias("_fp"), F.col("n_grams").alias("_grams"),
        F.col("cell.block").alias("_block"), F.col("cell.value").alias("_value"),
    )
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp")))
    earliest = F.lit(len(layout))
    for k, (s, w) in reversed(list(enumerate(layout))):
        earliest = F.when(_block(F.col("fp"), s, w) == _block(F.col("_fp"), s, w), F.lit(k)).otherwise(earliest)
    same = (F.col("n_words") == F.col("_n")) & (F.col("block") == F.col("_block")) & (F.col("value") == F.col("_value"))
    pairs = asked.join(held, same & (distance <= radius) & (F.col("block") == earliest)).select(*ids, "item_id", "item_key", "n_grams", "_grams", distance.alias("distance"))

    of_window = grams.groupBy(*ids, "h").agg(F.count("*").alias("c"))
    of_item = item_grams.groupBy("item_id", "item_key", "h").agg(F.count("*").alias("_c")).withColumnsRenamed({"item_id": "_item", "item_key": "_key", "h": "_h"})
    for_pairs = pairs.join(of_item, pairs["item_id"].eqNullSafe(of_item["_item"]) & (pairs["item_key"] == of_item["_key"])).drop("_item", "_key")
    of_window = of_window.withColumnsRenamed({"doc_id": "_d", "key": "_k", "start": "_s", "n_words": "_w"})
    agree = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("start") == F.col("_s")) & (F.col("n_words") == F.col("_w")) & (F.col("h") == F.col("_h"))
    shared = for_pairs.join(of_window, agree).groupBy(*ids, "item_id", "n_grams", "_grams", "distance").agg(F.sum(F.least("c", "_c")).alias("both"))
    similarity = F.col("both") / (F.col("n_grams") + F.col("_grams") - F.col("both"))
    found = shared.select(*ids, "item_id", "distance", similarity.alias("similarity")).where(F.col("similarity") >= least)
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.col("distance").cast("long").alias("distance"), "similarity", "key")


def without_benchmark(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the documents that hold a window of an item."""
    found = written(contaminated_windows(docs, items, **options).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), "found")
    id_ = F.col("_row.doc_id")
    same = (row_key(id_, F.col("_row.text")) == F.col("_k")) & id_.eqNullSafe(F.col("_d"))
    return unboxed(boxed(docs).join(bounded(found, found.count()), same, "left_anti"), docs)
