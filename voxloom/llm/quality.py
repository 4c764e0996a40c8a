"""Quality rules by suffix-array repetition (operator 8)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, map_arrow, payload, union_runs
from voxloom.llm.suffixes import common_prefix, document_suffixes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_covered long, covered_fraction double, longest_repeat long, n_repeats long"
)


@dataclass(frozen=True)
class Limits:
    """``min_words``, ``window`` and ``max_repeat_percent`` are the base rule. The verdict on maximal repeats of at
    least ``min_repeat`` words: their union may cover ``max_covered`` of the words, the longest ``max_longest`` words. Both
    are stricter than the base rule, as long repeats are no accident of common phrases."""

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    min_repeat: int = 10
    max_covered: float = 0.15
    max_longest: int = 60


def repeats(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place, the longest sequence starting there that also starts elsewhere in its document.

    Neighbours in the suffix array bound the common-prefix interval a suffix lies in, so the greater of its two
    common prefixes is the length of the maximal repeat at that place.
    """
    best = np.zeros(len(ids), np.int64)
    if len(ids) < 2:
        return best
    sa, levels = document_suffixes(ids, doc, end)
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    shared = common_prefix(a, b, end[a], end[b], levels)
    np.maximum.at(best, a, shared)
    np.maximum.at(best, b, shared)
    return best


def covered(best: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the repeats of at least ``least`` symbols, as runs."""
    place = np.flatnonzero(best >= least)
    return union_runs(place, place + best[place])


def _rows(ids: list, texts: list[bytes], limits: Limits) -> dict[str, list]:
    vocabulary: dict[bytes, int] = {}
    words = [text.split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in words for w in ws), np.int64, int(counts.sum()))
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(words)), counts)
    best = repeats(flat, doc, np.repeat(ends, counts))

    def per_document(least: int) -> tuple[np.ndarray, np.ndarray]:
        start, end = covered(best, least)  # runs end inside their document, touching runs of two documents may join
        mark = np.zeros(len(flat) + 1, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, end, -1)
        inside = np.r_[0, np.cumsum(np.cumsum(mark[:-1]) > 0)]
        fresh = np.r_[0, np.cumsum(best >= least)]
        return inside[ends] - inside[ends - counts], fresh[ends] - fresh[ends - counts]

    base, _ = per_document(limits.window)
    wide, starts = per_document(limits.min_repeat)
    longest = np.zeros(len(words), np.int64)
    np.maximum.at(longest, doc, best)
    longest[longest < limits.min_repeat] = 0
    failed = (counts < limits.min_words) | (100 * base > limits.max_repeat_percent * counts)
    share = wide / np.maximum(counts, 1)
    out: dict[str, list] = {
        "doc_id": ids, "n_words": counts, "n_repeat_words": base, "base_failed": failed,
        "kept": ~failed & (share <= limits.max_covered) & (longest <= limits.max_longest),
        "n_covered": wide, "covered_fraction": share, "longest_repeat": longest, "n_repeats": starts,
    }
    out["word_chars"] = [len(t) - sum(t.count(bytes([c])) for c in SPACES) - _continuations(t) for t in texts]
    out["n_symbols"] = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    out["n_dup_lines"] = [_repeated_lines(t) for t in texts]
    return out


def _continuations(text: bytes) -> int:
    if text.isascii():
        return 0
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 == 0x80))


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: base counts, maximal repeats and the verdict.

    A null or empty text has no words and fails. Rows are judged one by one, so repeated ids and null ids give a row
    each; other columns are ignored. A word is a run without ASCII white space.
    """
    lean = docs.select(F.col(id_col).alias("doc_id"), payload(F.col(text_col)).alias("body"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for part in blocks(batches, ["doc_id", "body"], "body", 3 << 20):
            yield _rows(part["doc_id"], part["body"], limits)

    return map_arrow(lean, work, SCHEMA)
