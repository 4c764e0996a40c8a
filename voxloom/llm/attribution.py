"""Token counts of sections by offset mapping (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, map_arrow, payload
from voxloom.llm.tokens import encoder, paths

RULES = ("start", "end", "most")


def lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines that are not blank, without their line ends."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(raw == 10)
    start, end = np.r_[0, edge + 1], np.r_[edge, len(raw)]
    ink = np.r_[0, np.cumsum(~((raw == 32) | ((raw >= 9) & (raw <= 13))))]
    full = ink[end] > ink[start]
    return start[full], end[full]


def allocate(token_end: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses an edge of a section it touches.

    Tokens are gapless; ``token_end`` are their ends. Sections are sorted and disjoint. A token that touches one section
    goes there. One that touches several goes to the first (``start``), the last (``end``) or the one that it shares
    the most bytes with, the first of equals (``most``).
    """
    token_start = np.r_[0, token_end[:-1]].astype(np.int64)
    first = np.searchsorted(end, token_start, "right")
    last = np.searchsorted(start, token_end, "left") - 1
    touches = (first <= last) & (first < len(start))
    at = np.where(touches, last if rule == "end" else first, -1)
    if rule == "most":
        for k in np.flatnonzero(touches & (last > first)):
            i = np.arange(first[k], last[k] + 1)
            at[k] = i[np.argmax(np.minimum(end[i], token_end[k]) - np.maximum(start[i], token_start[k]))]
    inside = np.where(touches, first, 0)
    whole = touches & (first == last)
    if len(start):
        whole &= (start[inside] <= token_start) & (token_end <= end[inside])
    return at, touches & ~whole


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[bytes], tuple[np.ndarray, np.ndarray]] = lines,
    rule: str = "start", vocabulary: str = "byte_bpe_50k",
) -> DataFrame:
    """Rows doc_id, section, start, end, n_tokens, n_crossing: tokens of each section of each document.

    The whole text is encoded once; token spans are the running sums of the tokens' byte lengths, joined with the
    sections' spans (bytes, from ``sections``, sorted and disjoint) by binary search, and a token across an edge goes where
    ``rule`` says (see ``allocate``), so the counts of a document add up to its tokens. n_crossing counts the section's
    tokens that reach outside of it. Section -1, start and end null, has the tokens that touch no section; it is
    there for every document, so null and empty texts give one row with no tokens. Rows with null or repeated ids
    are counted each on its own; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    files = paths(vocabulary)
    lean = docs.select(F.col(id_col).alias("doc_id"), payload(F.col(text_col)).alias("body"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(*files)
        for part in blocks(batches, ["doc_id", "body"], "body", 2 << 20):
            ids, section, starts, ends, tokens, crossing = [], [], [], [], [], []
            for doc_id, body in zip(part["doc_id"], part["body"], strict=True):
                start, end = sections(body)
                at, crosses = allocate(np.cumsum(encode.lengths[encode.ids(body.decode())]), start, end, rule)
                n = len(start) + 1
                ids += [doc_id] * n
                section += range(-1, n - 1)
                starts += [None, *start.tolist()]
                ends += [None, *end.tolist()]
                tokens += np.bincount(at + 1, minlength=n).tolist()
                crossing += np.bincount(at[crosses] + 1, minlength=n).tolist()
            yield {"doc_id": ids, "section": section, "start": starts, "end": ends, "n_tokens": tokens, "n_crossing": crossing}

    return map_arrow(lean, work, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")
