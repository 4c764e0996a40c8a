"""Ranked lexical search: every item's best documents, found in FP-trees of term vectors by branch and bound.

Documents are read once for their terms among those of the items (restricted vectors) and for the corpus counts that the
weights need. Per block of documents the vectors, most frequent term first, form a trie whose documents share paths. A
subtree knows the largest count of each of its terms and its smallest length norm; both bound what an item can score below
it, so the search, depth first, leaves a subtree as soon as no item can better its twentieth document there. What the
tasks keep (twenty rows an item) is ranked by Spark in two salted steps.

Nulls: a null text has no terms; null ids stand after all others among equal scores. Repeated rows are documents of
their own, repeated items are ranked each by itself. Items without terms and documents without a shared term give no rows,
as do empty tables. Texts and vectors are whole, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import small_batches, written

TOP = 20
LEAF = 16
ITEM_CELLS = 4_000_000  # of the table items x terms that a task holds
TREE_CELLS = 64_000_000  # of the tables of largest counts of one block's subtrees
SALTS = 64
_UNIT = 1_000_000_000
_NO_ID = -(2**63) - 1  # below every negated id
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _WORD else b + 32 if b + 32 in _WORD and 0x41 <= b <= 0x5A else 0x20 for b in range(256))

VECTORS = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
    ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])
HITS = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII, as UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_blocks(items: DataFrame) -> Iterator[tuple[list[int | None], list[Counter], dict[bytes, int]]]:
    """Items in blocks whose table items x terms stays below ``ITEM_CELLS``: ids, term counts, and the terms' numbers."""
    ids, counts, vocabulary = [], [], {}
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        found = Counter(terms(text))
        if not found:
            continue
        fresh = sum(t not in vocabulary for t in found)
        if ids and (len(ids) + 1) * (len(vocabulary) + fresh) > ITEM_CELLS:
            yield ids, counts, vocabulary
            ids, counts, vocabulary = [], [], {}
        ids.append(item_id)
        counts.append(found)
        for t in found:
            vocabulary.setdefault(t, len(vocabulary))
    if ids:
        yield ids, counts, vocabulary


def _lists(parts: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.fromiter((x for part in parts for x in part), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def restricted(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Per document with a known term its length and counts; per task one more row: documents, terms, and documents per term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df = np.zeros(len(known), np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms(text.as_py())
                n_docs += bool(words)
                n_terms += len(words)
                counts = {known[t]: c for t, c in Counter(words).items() if t in known}
                if counts:
                    df[list(counts)] += 1
                    for column, value in zip(rows, (doc_id.as_py(), len(words), list(counts), list(counts.values())), strict=True):
                        column.append(value)
            none = pa.nulls(len(rows[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), _lists(rows[2]), _lists(rows[3]), none, none], schema=VECTORS)
        seen = np.flatnonzero(df)
        one = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [one, one, _lists([seen.tolist()]), _lists([df[seen].tolist()]), pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], schema=VECTORS
        )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>, n_docs long, n_terms long")


class Trie:
    """Sorted vectors as nested runs: a run's documents share the path of their first terms.

    ``children[k]`` are the runs below run ``k``; runs of up to ``LEAF`` documents aren't divided. ``largest[k]`` holds the
    largest count of each term in run ``k``, ``least[k]`` its smallest norm.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], norms: np.ndarray, width: int):
        keys = [ids.astype(">u4").tobytes() for ids, _ in vectors]
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        shared = np.zeros(len(keys), np.int64)
        for at in range(1, len(keys)):
            a, b = vectors[self.order[at - 1]][0], vectors[self.order[at]][0]
            k = min(len(a), len(b))
            unlike = np.flatnonzero(a[:k] != b[:k])
            shared[at] = unlike[0] if len(unlike) else k
        self.runs = [(0, len(keys))]
        self.children: list[list[int]] = []
        for lo, hi in self.runs:  # grows while it is walked
            below: list[int] = []
            if hi - lo > LEAF:
                inner = shared[lo + 1 : hi]
                cuts = np.flatnonzero(inner == inner.min()) + lo + 1
                edges = [lo, *cuts.tolist(), hi]
                small = -1
                for a, b in zip(edges, edges[1:], strict=False):
                    if small >= 0 and b - small <= LEAF:  # neighbours too few to divide stand together
                        self.runs[below[-1]] = (small, b)
                        continue
                    below.append(len(self.runs))
                    self.runs.append((a, b))
                    small = a if b - a <= LEAF else -1
            self.children.append(below)
        self.largest = np.zeros((len(self.runs), width), np.int32)
        self.least = np.zeros(len(self.runs), np.int64)
        for k in range(len(self.runs) - 1, -1, -1):
            row = self.largest[k]
            if self.children[k]:
                np.max(self.largest[self.children[k]], axis=0, out=row)
                self.least[k] = self.least[self.children[k]].min()
            else:
                here = self.order[slice(*self.runs[k])]
                for d in here:
                    ids, tfs = vectors[d]
                    row[ids] = np.maximum(row[ids], tfs)
                self.least[k] = norms[here].min()


def saturated(tf: np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return (_UNIT * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


class Best:
    """The best documents of each item so far, and the score a further one must reach."""

    def __init__(self, n_items: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.bar = np.ones(n_items)

    def offer(self, item: int, score: int, tie: int) -> None:
        heap = self.heaps[item]
        if len(heap) < TOP:
            heappush(heap, (score, tie))
        else:
            heappushpop(heap, (score, tie))
        if len(heap) == TOP:
            self.bar[item] = heap[0][0]


def search(vectors: list[tuple[np.ndarray, np.ndarray]], norms: np.ndarray, ties: list[int], weights: np.ndarray, best: Best) -> None:
    """Depth first through the trie with the items that can still gain below a run; ``weights`` is terms x items."""
    trie = Trie(vectors, norms, len(weights))
    stack = [(0, np.arange(weights.shape[1]))]
    while stack:
        run, items = stack.pop()
        lo, hi = trie.runs[run]
        if hi - lo > 1:
            bound = saturated(trie.largest[run], trie.least[run]).astype(weights.dtype) @ weights
            items = items[bound[items] >= best.bar[items]]
            if not len(items):
                continue
        if trie.children[run]:
            stack += [(k, items) for k in trie.children[run]]
            continue
        for d in trie.order[lo:hi]:
            ids, tfs = vectors[d]
            scores = saturated(tfs, norms[d]).astype(weights.dtype) @ weights[ids]
            for item in items[scores[items] >= best.bar[items]].tolist():
                best.offer(item, int(scores[item]), ties[d])


def _searched(vectors: DataFrame, plan: Broadcast) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, rank, weights, n_docs, n_terms = plan.value
        best = Best(len(item_ids))
        room = max(64, TREE_CELLS * LEAF // (4 * len(weights)))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        norms: list[int] = []
        ties: list[int] = []

        def work() -> None:
            if held:
                search(held, np.array(norms, np.int64), ties, weights, best)
                held.clear(), norms.clear(), ties.clear()

        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            ids, tfs = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for i, (doc_id, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = rank[ids[ends[i] : ends[i + 1]]]
                sort = np.argsort(own)
                held.append((own[sort], tfs[ends[i] : ends[i + 1]][sort]))
                norms.append(75 + (25 * n * n_docs) // n_terms)
                ties.append(_NO_ID if doc_id is None else -doc_id)
                if len(held) >= room:
                    work()
        work()
        rows = [(i, item_ids[i], None if t == _NO_ID else -t, s) for i, heap in enumerate(best.heaps) for s, t in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=HITS)

    return vectors.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _first(hits: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``TOP`` best documents of each item.

    Items are a stated query set: they are taken in blocks of bounded size, each against all documents.
    """
    spark = docs.sparkSession
    found = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for item_ids, counts, vocabulary in item_blocks(items):
        vectors = written(restricted(docs, spark.sparkContext.broadcast(vocabulary)), "vectors")
        stats = vectors.where("n_docs is not null")
        n_docs, n_terms = stats.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            continue
        pairs = stats.select(F.explode(F.arrays_zip("ids", "tfs")).alias("p")).groupBy("p.ids").agg(F.sum("p.tfs").alias("df"))
        df = np.zeros(len(vocabulary), np.int64)
        for term, held in pairs.collect():  # one row per term of the block
            df[term] = held
        rank = np.empty(len(df), np.int32)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df), dtype=np.int32)
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
        most = max(sum(c * w[vocabulary[t]] for t, c in item.items()) for item in counts)
        # Doubles hold sums below 2**53 without loss and multiply fast; beyond it, whole numbers.
        weights = np.zeros((len(df), len(item_ids)), np.float64 if most * 1_000_000 < 2**53 else np.int64)
        for i, item in enumerate(counts):
            for t, c in item.items():
                weights[rank[vocabulary[t]], i] = c * w[vocabulary[t]]
        plan = spark.sparkContext.broadcast((item_ids, rank, weights, n_docs, n_terms))
        hits = _searched(vectors.where("n is not null").select("doc_id", "n", "ids", "tfs"), plan)
        hits = _first(hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "item", "salt")
        found.append(_first(hits, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)
