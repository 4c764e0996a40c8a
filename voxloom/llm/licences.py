"""Fuzzy search for short licence notices (operator 4)."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, map_arrow, payload

# Phrases whose exact places are counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices that are found with a few edits, with their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution", "cc"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)
CHARS_PER_EDIT = 10
#: other bytes to spaces, A-Z to a-z
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int
    seeds: tuple[tuple[int, bytes], ...]  # place in the notice, bytes
    pattern: regex.Pattern


@cache
def notices(chosen: tuple[tuple[str, str], ...], per_edit: int) -> tuple[Notice, ...]:
    """A notice with k edits is cut into k + 1 seeds: at least one of them stands unedited in every match."""
    out = []
    for text, label in chosen:
        raw = text.encode()
        edits = len(raw) // per_edit
        edge = [round(i * len(raw) / (edits + 1)) for i in range(edits + 2)]
        seeds = tuple((a, raw[a:b]) for a, b in zip(edge, edge[1:], strict=False))
        pattern = regex.compile(b"(?b)(?:" + regex.escape(raw, literal_spaces=True) + b"){e<=%d}" % edits)
        out.append(Notice(raw, label, edits, seeds, pattern))
    return tuple(out)


def _places(text: bytes, what: bytes) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def _best_first(text: bytes, notice: Notice, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """Matches in a short stretch: the best one, and what lies before and after it."""
    if b - a < len(notice.text) - notice.edits:
        return
    m = notice.pattern.search(text, a, b)
    if m is not None and m.end() > m.start():
        yield from _best_first(text, notice, a, m.start())
        yield m.start(), m.end(), sum(m.fuzzy_counts)
        yield from _best_first(text, notice, m.end(), b)


def find_notice(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the matches in single-spaced text, from left to right.

    Stretches around seeds are searched in steps of about two notices, so the work grows with their length however
    many of them touch.
    """
    around: list[list[int]] = []
    reach = len(notice.text) + notice.edits
    for at in sorted(p - offset for offset, seed in notice.seeds for p in _places(text, seed)):
        a, b = max(0, at - notice.edits), min(len(text), at + reach)
        if around and a <= around[-1][1]:
            around[-1][1] = max(b, around[-1][1])
        else:
            around.append([a, b])
    found: list[tuple[int, int, int]] = []
    for at, b in around:
        while b - at >= len(notice.text) - notice.edits:
            m = notice.pattern.search(text, at, min(b, at + 2 * reach))
            if m is None or m.end() == m.start():
                at += reach
                continue
            found += _best_first(text, notice, at, m.start())
            if m.start() >= at + reach:  # it may go on beyond this step
                at = m.start()
                continue
            found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            at = m.end()
    return found


def scan(body: bytes, wanted: tuple[Notice, ...], base: tuple[tuple[str, str], ...] = BASE) -> dict:
    """Exact places of the base phrases and fuzzy matches of the notices in one text."""
    words = body.translate(PLAIN).split()
    text = b" " + b" ".join(words) + b" "
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    places, labels = [], set()
    for phrase, label in base:
        own = np.searchsorted(spaces, list(_places(text, b" %s " % phrase.encode()))).tolist()
        places += own
        if own:
            labels.add(label)
    base_labels = ",".join(sorted(labels))
    spans, best = [], 1.0 if places else 0.0
    matches = [(edits, start - end, start, end, notice) for notice in wanted for start, end, edits in find_notice(text, notice)]
    taken: list[tuple[int, int]] = []  # disjoint, ascending
    for edits, _, start, end, notice in sorted(matches, key=lambda m: m[:4]):
        at = bisect(taken, (start, end))
        if (not at or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):  # fewer edits first, then the longer
            taken.insert(at, (start, end))
            labels.add(notice.label)
            score = 1 - edits / len(notice.text)
            best = max(best, score)
            first = int(np.searchsorted(spaces, start + (text[start : start + 1] == b" "))) - 1
            last = int(np.searchsorted(spaces, end - (text[end - 1 : end] == b" "))) - 1
            spans.append((notice.label, first, last, edits, score))
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": base_labels, "labels": ",".join(sorted(labels)), "score": best, "spans": sorted(spans, key=lambda s: (s[1], s[0])),
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_matches long, spans string"


def licence_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    chosen: tuple[tuple[str, str], ...] = NOTICES, per_edit: int = CHARS_PER_EDIT, base: tuple[tuple[str, str], ...] = BASE,
) -> DataFrame:
    """One row per document: words, exact places of the base phrases, labels, score and the spans of fuzzy matches.

    A notice matches with up to one edit per ``per_edit`` of its characters (bytes of the lower-cased, single-spaced
    text). The score is 1 if a base phrase stands there exactly, else that of the best match (1 less its edits' share),
    else 0. ``spans`` lists label:first word-last word:edits, in order of place. A null or empty text has no words and
    score 0; repeated rows and null ids give a row each; other columns are ignored.
    """
    lean = docs.select(F.col(id_col).alias("doc_id"), payload(F.col(text_col)).alias("body"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        wanted = notices(chosen, per_edit)
        for part in blocks(batches, ["doc_id", "body"], "body"):
            rows = [scan(body, wanted, base) for body in part["body"]]
            out = {name: [r[name] for r in rows] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            out["doc_id"] = part["doc_id"]
            out["n_matches"] = [len(r["spans"]) for r in rows]
            out["spans"] = [" ".join(f"{label}:{a}-{b}:{e}" for label, a, b, e, _ in r["spans"]) for r in rows]
            yield out

    return map_arrow(lean, work, SCHEMA)
