"""Operators 6 and 9 against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import bytes_dedup, substrings
from voxloom.llm.bytes_dedup import prefix_classes
from tests.llm.corpus import frame, rows

BIG = 2**63 - 1


def order(i):
    return BIG if i is None else i


def words_by_hand(data, window=13):
    first, split = {}, [(order(i), (t or "").encode().split()) for i, t in data]
    for i, w in split:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, BIG), i)
    out = []
    for (raw_id, _), (i, w) in zip(data, split, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((raw_id, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def bytes_by_hand(data, key, length=100):
    unique = sorted({(order(i), key(i, t), (t or "").encode()) for i, t in data})
    seen, result = set(), {}
    for o, k, body in unique:
        gone = np.zeros(len(body) + 1, int)
        for j in range(len(body) - length + 1):
            s = body[j : j + length]
            if s in seen:
                gone[j : j + length] = 1
            seen.add(s)
        kept = bytes(b for b, g in zip(body, gone, strict=False) if not g)
        result[o, body] = (len(body), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted(((i, *result[order(i), (t or "").encode()]) for i, t in data), key=str)


def test_words(spark):
    data = rows()
    found = substrings.dedup_words(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == words_by_hand(data)


def test_words_with_unique_ids(spark):
    data = list(dict(rows(3)).items())
    found = substrings.dedup_words(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == words_by_hand(data)


def test_bytes(spark):
    data = rows()
    df = frame(spark, data)
    from pyspark.sql import functions as F

    from voxloom.llm.common import row_key

    keys = {(r.doc_id, r.text): r.k for r in df.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    found = bytes_dedup.dedup_bytes(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == bytes_by_hand(data, lambda i, t: keys[i, t])


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert substrings.dedup_words(empty).collect() == []
    assert bytes_dedup.dedup_bytes(empty).collect() == []
    assert substrings.without_repeats(empty).collect() == []


def test_stage_keeps_columns_and_what_is_not_repeated(spark):
    data = list(dict(rows(5)).items())
    df = frame(spark, data)
    kept = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert substrings.without_repeats(df).columns == df.columns
    hashes = {i: (n, gone, sha) for i, n, gone, sha in words_by_hand(data)}
    texts = dict(data)
    for i, (n, gone, sha) in hashes.items():
        if gone and gone == n:
            assert i not in kept
        elif gone:
            assert hashlib.sha256(b" ".join(kept[i].text.encode().split())).hexdigest() == sha
            assert kept[i].n_chars == len(kept[i].text)
        else:
            assert kept[i].text == texts[i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=12), min_size=1, max_size=6), st.integers(1, 6))
def test_prefix_classes(strings, length):
    text = np.frombuffer(b"\xff".join(s.encode() for s in strings) + b"\xff", np.uint8)
    ring = np.r_[text, np.resize(text, length)]
    number = prefix_classes(text, length)
    by_hand = [ring[i : i + length].tobytes() for i in range(len(text))]
    assert len(set(zip(number.tolist(), by_hand, strict=True))) == len(set(by_hand)) == len(set(number.tolist()))


@pytest.mark.parametrize("text", ["", "a", "a b c"])
def test_cut_words_without_spans(text):
    assert substrings.cut_words(text, [], 13) == text
