"""SimHash near copies by multi-index hashing (operator 2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, boxed, map_arrow, mix, passing, payload, row_key, unboxed, written

BITS = 64
HEADS = 4  # nodes of a band that all others are held against before what is left meets by its deltas
FEW = 12  # nodes of a band that are compared with each other as they are
REFERENCE = 32  # nodes of a band that set what its deltas differ from


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    keep = max(1, len(words) - size + 1)
    pairs = zip(start[:keep].tolist(), end[min(size, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], seed) for i, j in pairs), np.uint64, keep)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; no hashes, no bits. As a signed number."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):  # very long texts
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, key (tells rows of one id apart) and fp. A null or empty text has fingerprint zero."""
    lean = docs.select(
        F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), payload(F.col(text_col)).alias("body")
    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for part in blocks(batches, ["doc_id", "key", "body"], "body"):
            yield {"doc_id": part["doc_id"], "key": part["key"], "fp": [fingerprint(shingle_hashes(t, shingle, seed)) for t in part["body"]]}

    return map_arrow(lean, work, "doc_id long, key long, fp long")


def segments(radius: int, parts: int = 3) -> list[tuple[int, int, int]]:
    """(shift, width, ball): two fingerprints within ``radius`` differ in at most ``ball`` bits of some segment.

    Were every segment to exceed its ball, the whole would exceed the sum of (ball + 1), which is radius + 1.
    """
    width, out, shift = BITS // parts, [], 0
    for k in range(parts):
        w = width if k < parts - 1 else BITS - shift
        out.append((shift, w, (radius + 1) // parts + (k < (radius + 1) % parts) - 1))
        shift += w
    return out


def _ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _keys(fps: DataFrame, name: str, layout: list[tuple[int, int, int]], asked: bool) -> DataFrame:
    """One row per segment and key: the segment's value with each mask of its ball. A ball of radius r is met halfway:
    the asking side flips up to half of it (rounded up), the table the rest."""
    entries = []
    for k, (shift, width, ball) in enumerate(layout):
        if ball < 0:
            continue
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) if shift else F.col("fp").bitwiseAND(F.lit((1 << width) - 1))
        masks = _ball(width, (ball + 1) // 2 if asked else ball // 2)
        base = value.bitwiseOR(F.lit(k << width + 1))
        entries.append(F.array(*[base.bitwiseXOR(F.lit(m).cast("long")) for m in masks]))
    return fps.select(F.col("fp").alias(name), F.explode(F.flatten(F.array(*entries))).alias(f"{name}_key"))


def _met_first(a: Column, b: Column, key: Column, layout: list[tuple[int, int, int]]) -> Column:
    """Whether this is the one key under which a pair counts: its first near segment, the lowest bits flipped first."""
    chosen = F.lit(None).cast("long")
    for k, (shift, width, ball) in reversed(list(enumerate(layout))):
        if ball < 0:
            continue
        part = F.lit((1 << width) - 1)
        x = F.shiftrightunsigned(a, shift).bitwiseAND(part)
        y = F.shiftrightunsigned(b, shift).bitwiseAND(part)
        differ = x.bitwiseXOR(y)
        flips, rest = F.lit(0).cast("long"), differ
        for _ in range((ball + 1) // 2):  # the asking side takes the lowest differing bits
            low = rest.bitwiseAND(-rest)
            flips, rest = flips.bitwiseOR(low), rest.bitwiseXOR(low)
        chosen = F.when(F.bit_count(differ) <= ball, x.bitwiseXOR(flips).bitwiseOR(F.lit(k << width + 1))).otherwise(chosen)
    return key == chosen


def near_pairs(fps: DataFrame, radius: int, parts: int = 3) -> DataFrame:
    """All pairs (a < b, distance) of different fingerprints in column ``fp`` that differ in at most ``radius`` bits, once each."""
    layout = segments(radius, parts)
    distinct = fps.select("fp").distinct()
    asking, held = _keys(distinct, "a", layout, True), _keys(distinct, "b", layout, False)
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = (asking["a_key"] == held["b_key"]) & (F.col("a") < F.col("b")) & (distance <= radius)
    return asking.join(held, met & _met_first(F.col("a"), F.col("b"), F.col("a_key"), layout)).select("a", "b", distance.alias("distance"))


def components(pairs: DataFrame) -> DataFrame:
    """Label of each node of ``pairs(a, b)``: the least node that it reaches, as (node, label).

    Each round hangs every node's neighbours below its least neighbour, from both sides in turn, until all edges
    point at the least node of their component. Rounds grow with the logarithm of the longest chain; each writes its
    edges to the shared folder, and the driver sees only whether something changed.
    """
    edges = written(pairs.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["w"]).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # each node to the least of its smaller neighbours, and those neighbours to it
        small = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("w"), "m")
        joined = large.join(small, large["b"] == small["w"])
        hung = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(joined.select(F.col("m").alias("a"), "b")).distinct()
        after = written(hung, "edges")
        # a star forest: each node has one parent, and no parent has one
        again = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() + after.join(
            after.select(F.col("b").alias("a")), "a", "left_semi"
        ).limit(1).count()
        edges = after
        if not again:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id, n_links (other fingerprints linked).

    Documents link if their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id
    reachable. Equal fingerprints are one node, so copies make no pairs. A null or empty text has fingerprint zero. A row
    without an id gets a row too but never names a component of others; repeated rows each get theirs.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle, seed), "prints").drop("key")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    pairs = written(near_pairs(nodes, radius), "pairs")
    labels = components(pairs)
    ends = pairs.select(F.col("a").alias("of")).unionByName(pairs.select(F.col("b").alias("of"))).groupBy("of").agg(F.count("*").alias("n_links"))
    joined = nodes.join(labels, nodes["fp"] == labels["node"], "left").withColumn("label", F.coalesce("label", "fp"))
    least = joined.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "_label")
    known = joined.join(least, joined["label"] == least["_label"]).select(F.col("fp").alias("_fp"), "component_id")
    known = known.join(ends, known["_fp"] == ends["of"], "left").select("_fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(known, prints["fp"] == known["_fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def word_shingles(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a: bytes, b: bytes, size: int) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without words are equal."""
    x, y = word_shingles(a, size), word_shingles(b, size)
    return len(x & y) / len(x | y) if x or y else 1.0


def band_keys(hashes: np.ndarray, bands: int, rows: int, seed: int) -> list[int]:
    """``bands`` keys of a set of shingle hashes, each of ``rows`` minima under different scrambles.

    One minimum of two sets agrees with the probability of their Jaccard similarity, so a band does with its power ``rows``.
    """
    place = np.arange(1, bands * rows + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32))
    flip, odd = mix(place), mix(~place) | np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 256):  # very long texts
        np.minimum(least, ((hashes[i : i + 256, None] ^ flip) * odd).min(0), out=least)
    digests = [xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _verified(asked: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    asked = written(asked.select("a", "b"), "asked")
    wanted = asked.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    bodies = written(texts.join(wanted, texts["_key"] == wanted["key"]).dropDuplicates(["_key"]).select("node", "body"), "bodies")
    left, right = bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True)
            kept = [(a.as_py(), b.as_py()) for a, b, x, y in rows if x.equals(y) or similarity(x.as_py(), y.as_py(), shingle) >= least]
            yield {"a": [a for a, _ in kept], "b": [b for _, b in kept]}

    return written(map_arrow(asked.join(right, "b").join(left, "a"), verify, "a long, b long"), "sure")


def _labelled(df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """With the component of a node; one that has no label is its own."""
    known = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return df.join(known, F.col(node) == F.col("_n"), "left").withColumn(label, F.coalesce("_l", node)).drop("_n", "_l")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links, found among the components that these join."""
    if not links.limit(1).count():
        return labels
    ends = _labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb")
    moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    after = _labelled(labels.select("node", F.col("label").alias("was")), moved, "was", "label").select("node", "label")
    return written(after.unionByName(moved.join(labels, "node", "left_anti").select("node", "label")), "labels")


def _possible(least: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - F.lit(1e-6)


def _shingle_sets(bodies: DataFrame, shingle: int, seed: int) -> DataFrame:
    """node and its shingle hashes, each once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for part in blocks(batches, ["node", "body"], "body"):
            yield {"node": part["node"], "hashes": [np.unique(shingle_hashes(t, shingle, seed)).view(np.int64).tolist() for t in part["body"]]}

    return written(map_arrow(bodies.select("node", "body"), work, "node long, hashes array<long>"), "sets")


def _deltas(apart: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Each band's nodes as differences from what is common there: band, node, n, label, delta, f.

    Any reference would do; it is the shingles of more than half of about ``REFERENCE`` nodes. Two sets are as different as
    their deltas are, so similarity ``least`` or more means: the deltas differ in at most q (n_a + n_b) shingles, where
    q = (1 - least) / (1 + least), or, with f = size - q n, share at least (f_a + f_b) / 2.
    """
    counted = apart.groupBy("band").agg(F.ceil(F.count("*") / REFERENCE).alias("_every"))
    sample = apart.join(counted, "band").where(F.pmod(F.xxhash64("node", "band"), F.col("_every")) == 0).select("band", "node")
    size = sample.groupBy("band").agg(F.count("*").alias("_m"))
    common = sample.join(sets, "node").select("band", F.explode("hashes").alias("s")).groupBy("band", "s").agg(F.count("*").alias("c"))
    core = common.join(size, "band").where("2 * c > _m").groupBy("band").agg(F.collect_list("s").alias("core"))
    rows = apart.join(sets, "node").join(core, "band", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    delta = F.array_union(F.array_except("hashes", "core"), F.array_except("core", "hashes"))
    rows = rows.select("band", "node", "n", "label", delta.alias("delta"))
    return rows.withColumn("f", F.size("delta") - F.lit((1 - least) / (1 + least)) * F.col("n"))


def _overlapping(delta: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components whose deltas may share enough, by their rarest elements.

    ``delta`` also has the band's least f (``fz``) and its node's label (``zl``). Nodes of that component need no partner
    among themselves, so every pair has a node of another one, and their least f bounds what a partner must share: a
    set of d elements that shares o with another has one of its d - o + 1 rarest among the other's d' - o + 1 rarest.
    Each side's o comes from the least f that its partner can have. Edits of one copy alone are in no other delta, so what
    is common to all of a group never becomes a key, and pairs too far apart don't meet.
    """
    others = delta.where("label <> zl").groupBy("band").agg(F.min("f").alias("g"))
    delta = written(delta.join(others, "band"), "others")
    each = delta.select("band", "node", F.explode("delta").alias("s"))
    shared = each.groupBy("band", "s").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(shared, ["band", "s"]).groupBy("band", "node").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("ranked"))
    rows = written(delta.select("band", "node", "n", "label", "zl", "f", "fz", "g", F.size("delta").alias("d")).join(ranked, ["band", "node"]), "ranked")

    def prefix(partner: str) -> Column:
        overlap = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col(partner)) / 2 - 1e-9))
        alone = F.col("d") - F.size("ranked")  # the rarest of all
        keep = F.greatest(F.lit(0), F.col("d") - overlap + 1 - alone).cast("int")
        return F.explode(F.slice("ranked", F.lit(1), keep)).alias("e")

    x = rows.where("label <> zl").select("band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), prefix("fz"))
    y = rows.select("band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), prefix("g"))
    x, y = x.withColumn("s", F.col("e.s")).drop("e"), y.withColumn("s", F.col("e.s")).drop("e")
    met = x.join(y, ["band", "s"]).where((F.col("la") != F.col("lb")) & _possible(least))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near_copies(docs: DataFrame, shingle: int, least: float, bands: int, rows: int, seed: int, radius: int) -> DataFrame:
    """Ids and keys of the rows that another row of their group replaces, as ``_id`` and ``_gone``."""
    key = row_key(F.col("doc_id"), F.col("text"))
    lean = docs.select("doc_id", key.alias("key"), payload(F.col("text")).alias("body"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for part in blocks(batches, ["doc_id", "key", "body"], "body"):
            hashes = [shingle_hashes(t, shingle, seed) for t in part["body"]]
            fp = [fingerprint(h) for h in hashes]
            sets = [np.unique(h) for h in hashes]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
            yield {"doc_id": part["doc_id"], "key": part["key"], "node": node, "n": [len(s) for s in sets], "bands": [band_keys(s, bands, rows, seed) for s in sets], "fp": fp}

    prints = written(map_arrow(lean, work, "doc_id long, key long, node long, n long, bands array<long>, fp long"), "prints")
    texts = docs.select(key.alias("_key"), payload(F.col("text")).alias("body"))
    # texts of one shingle set are similar to the same texts: one node
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "n", "bands", "fp")).alias("first")
    nodes = written(prints.groupBy("node").agg(first).select("node", "first.*"), "nodes")

    # near fingerprints first: each against its least neighbour, and against the head of one of its bands
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    equal = nodes.select("node", "fp").join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = near_pairs(nodes, radius).select("a", "b")
    for side in ("a", "b"):
        near = near.join(firsts.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}")), side)
    near = written(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "near")
    star = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(equal)
    each = nodes.select("node", "n", F.explode("bands").alias("band"))
    heads = each.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    members = written(each.join(heads, "band"), "members")
    one = members.groupBy("node").agg(F.min("head").alias("a")).where("node <> a").select("a", F.col("node").alias("b"))
    asked = star.unionByName(one).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = written(components(_verified(asked, nodes, texts, shingle, least)), "labels")

    def labelled(df: DataFrame, node: str, label: str) -> DataFrame:
        return _labelled(df, labels, node, label)

    def mixed(rows: DataFrame, *more: Column) -> DataFrame:
        """Bands that hold several components."""
        return rows.groupBy("band").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), *more).where("_lo <> _hi").drop("_lo", "_hi")

    # nodes of one component need no comparison. Near fingerprints meet each component that is still another one, and the
    # nodes of a band a few of its nodes at once
    other = labelled(labelled(near, "a", "la"), "b", "lb").where("la <> lb").groupBy("b", "la").agg(F.min("a").alias("a")).select("a", "b")
    apart = written(labelled(members.drop("head"), "node", "label"), "apart")
    few_heads = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(HEADS)]))
    star = apart.join(mixed(apart, few_heads.alias("heads")), "band").select(F.explode("heads").alias("a"), F.col("node").alias("b"), F.col("label").alias("lb"))
    star = labelled(star.where("a <> b").distinct(), "a", "la").where("la <> lb").select("a", "b").unionByName(other)
    asked = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = _joined(labels, _verified(asked, nodes, texts, shingle, least))

    apart = labelled(apart.drop("label"), "node", "label")
    apart = written(apart.join(mixed(apart), "band").select("band", "node", "n", "label"), "apart")
    # bands of a few nodes compare them all, which is linear in their rows
    crowd = apart.groupBy("band").agg(F.count("*").alias("_c")).where(F.col("_c") > FEW).select("band")
    few = apart.join(crowd, "band", "left_anti")
    x = few.select("band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = few.select("band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    met = x.join(y, "band").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _possible(least)).select("a", "b").distinct()
    labels = _joined(labels, _verified(met, nodes, texts, shingle, least))

    apart = written(labelled(apart.drop("label").join(crowd, "band"), "node", "label"), "crowded")
    wanted = apart.select("node").distinct().join(nodes.select("node", "key"), "node")
    delta = written(_deltas(apart, _shingle_sets(texts.join(wanted, texts["_key"] == wanted["key"]).dropDuplicates(["_key"]), shingle, seed), least), "deltas")
    least_of = delta.groupBy("band").agg(F.min(F.struct("f", "node")).alias("z")).select("band", F.col("z.node").alias("a"), F.col("z.f").alias("fz"))
    near = labelled(delta.join(least_of, "band").where("f + fz <= 1e-9 AND node <> a").select("a", F.col("node").alias("b"), "label"), "a", "la")
    labels = _joined(labels, _verified(near.where("la <> label").select("a", "b").distinct(), nodes, texts, shingle, least))
    delta = labelled(labelled(delta.drop("label").join(least_of, "band"), "node", "label"), "a", "zl")
    labels = _joined(labels, _verified(_overlapping(delta, least), nodes, texts, shingle, least))

    grouped = labelled(nodes.select("node", "none", "doc_id", "key"), "node", "label")
    best = grouped.groupBy("label").agg(F.min(F.struct("none", "doc_id", "key")).alias("best")).select("label", F.col("best.key").alias("best"))
    known = grouped.select("node", "label").join(best, "label").select("node", "best")
    gone = prints.select("node", "doc_id", "key").join(known, "node").where("key <> best")
    return gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_gone")).distinct()


def near_duplicates_out(docs: DataFrame, shingle: int = 5, least: float = 0.8, bands: int = 40, rows: int = 8, seed: int = 42, radius: int = 4) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one document of each group of near copies.

    Two texts are near copies if their sets of word shingles have a Jaccard similarity of ``least`` or more; groups are the
    components of these pairs, and the smallest doc_id of each stays (rows without an id only where no other is). Pairs
    are verified. Candidates are first the texts whose SimHash fingerprints (operator 2) differ in at most ``radius`` bits, by
    multi-index hashing. Fingerprints of 64 bits differ in 9.7 bits on average at 0.80, and a radius that finds those holds
    too many unrelated texts, so what is not linked by them meets by ``bands`` keys of ``rows`` minima: a pair at similarity
    s shares one with probability 1 - (1 - s ** rows) ** bands, 0.9994 at 0.80, over 0.99999 from 0.85. All links are found
    on the same input. Of rows equal in id and text one stays; null and empty texts are copies of each other.
    Of the tables written on the way only the rows to leave out outlive the call.
    """
    own = F.col("_row.doc_id")
    left = boxed(docs).withColumns({"_d": own, "_k": row_key(own, F.col("_row.text"))})
    with passing(docs.sparkSession):
        gone = written(_near_copies(docs.select("doc_id", "text"), shingle, least, bands, rows, seed, radius), "gone", lasting=True)
    same = (F.col("_k") == F.col("_gone")) & F.col("_d").eqNullSafe(F.col("_id"))
    return unboxed(left.join(gone, same, "left_anti").dropDuplicates(["_d", "_k"]), docs)
