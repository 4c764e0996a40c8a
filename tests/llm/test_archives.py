"""Operators 3, 7 and 10, and the pipeline."""

import base64
import hashlib
import io
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from voxloom.llm import decontaminate, training_order, warc
from voxloom.session import shared_dir
from tests.llm.corpus import frame, rows, texts


def plain(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks_by_hand(data, items, size=5, least=0.8):
    found = set()
    for i, t in data:
        w = plain(t)
        for item, text in items:
            v = plain(text)
            if len(v) < size:
                continue
            b = Counter(tuple(v[k : k + size]) for k in range(len(v) - size + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                part = w[s : s + len(v)]
                a = Counter(tuple(part[k : k + size]) for k in range(len(part) - size + 1))
                both = sum((a & b).values())
                if both and both / (sum(a.values()) + sum(b.values()) - both) >= least:
                    found.add((i, item))
    return found


def test_decontamination(spark):
    base = texts(8)
    items = [(1, base[1]), (2, base[2] + " Punctuated, text!"), (3, "too short"), (4, None), (5, ""), (6, base[20]), (7, base[1])]
    edited = base[20].split(" ")
    edited[len(edited) // 2] = "edit"
    data = [*enumerate(base), (90, "before it " + base[1].upper() + " and after"), (91, " ".join(edited)), (92, base[6] + " " + base[2] + " punctuated text"), (None, base[1])]
    df, known = frame(spark, data), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated_windows(df, known).collect()
    expected = leaks_by_hand(data, items)
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert {(90, 1), (91, 6), (92, 2), (None, 1), (1, 7)} <= expected
    left = decontaminate.without_benchmark(df, known)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in data if i not in {d for d, _ in expected})
    assert decontaminate.contaminated_windows(frame(spark, []), known).collect() == []
    assert decontaminate.contaminated_windows(df, known.limit(0)).collect() == []


def windows_by_hand(data, items, size=5, least=0.8):
    found = set()
    for i, t in data:
        w = plain(t)
        for item, text in items:
            v = plain(text)
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = (Counter(tuple(x[k : k + size]) for k in range(len(x) - size + 1)) for x in (w[s : s + len(v)], v))
                both = sum((a & b).values())
                if both / max(1, sum(a.values()) + sum(b.values()) - both) >= least:
                    found.add((i, item, s, len(v)))
    return found


def test_decontamination_lays_every_window(spark):
    rng = random.Random(3)

    def fresh(k):
        return [f"w{rng.randrange(10**6)}" for _ in range(k)]

    v, u, r = fresh(60), fresh(25), fresh(6) * 5
    items = [(1, " ".join(v)), (2, " ".join(u)), (3, " ".join(r)), (4, " ".join(v[:50]))]
    swapped, thirds, edited = v[30:] + v[:30], u[12:] + u[:12], [*v[:20], "other", *v[21:]]
    docs = [fresh(40) + v + fresh(40), fresh(40) + swapped + fresh(9), swapped, v[:57], u + fresh(3) + u, fresh(5) + thirds, r + r + fresh(4), fresh(3) + edited + v, fresh(80), v[:3]]
    data = [(i, " ".join(d)) for i, d in enumerate(docs)]
    found = decontaminate.contaminated_windows(frame(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = windows_by_hand(data, items)
    assert sorted((x.doc_id, x.item_id, x.start, x.n_words) for x in found) == sorted(expected)
    assert {(1, 1, 40, 60), (2, 1, 0, 60), (3, 1, 0, 60), (0, 1, 39, 60), (0, 1, 41, 60)} <= expected


def test_decontamination_is_native(spark):
    known = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = decontaminate.contaminated_windows(frame(spark, rows()), known)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(total):
    slots = training_order.permuted(np.arange(total), total, 9)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        assert (slots != np.arange(total)).mean() > 0.9
        assert (slots != training_order.permuted(np.arange(total), total, 10)).any()


def test_shards(spark):
    data = rows()
    folder = shared_dir(spark, "order")
    manifest = training_order.materialise(frame(spark, data), folder, stride=64, shard_records=16)
    found = sorted(training_order.read_shards(manifest).collect(), key=lambda r: r.slot)
    assert [r.slot for r in found] == list(range(len(found)))
    assert all(r.shard == r.slot // 16 for r in found)
    from tokenizers import Tokenizer

    from voxloom.llm.tokens import END, paths

    whole = Tokenizer.from_file(paths()[0])
    import zlib

    expected = []
    for i, t in data:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, END], "<u2")
        expected += [(i, k, len(own), zlib.crc32(own.tobytes())) for k in range(-(-len(ids) // 64)) if len(own := ids[k * 64 : k * 64 + 64])]
    assert sorted(((r.doc_id, r.piece, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(expected, key=str)
    resumed = training_order.read_shards(manifest, from_slot=21).collect()
    assert sorted(r.slot for r in resumed) == list(range(21, len(found)))
    assert training_order.training_order(spark, frame(spark, [])).collect() == []


def test_ids_on_the_way_are_short(spark):
    order = np.random.default_rng(3).permutation(1 << 16)
    codes = training_order.ShortIds(order)
    ids = np.r_[np.arange(1 << 16), order[:300], 0, 65535].astype("<u2")
    for stride in (1, 7, 512):
        pieces = codes.pieces(ids, stride)
        assert len(pieces) == -(-len(ids) // stride)
        assert codes.back(b"".join(pieces)) == ids.tobytes()
        assert codes.back(pieces[-1]) == ids[(len(pieces) - 1) * stride :].tobytes()
    from voxloom.llm.tokens import paths

    docs = frame(spark, [(i, f"the voice of speaker {i % 7} is heard in the hall again and again") for i in range(300)])
    codes = training_order.ShortIds(training_order.frequent_first(docs, "text", paths()))
    made = training_order.sequences(docs, 512, "doc_id", "text", paths(), codes).collect()
    assert sum(len(r.ids) for r in made) < 1.1 * sum(r.n_tokens for r in made)  # two bytes each before


PAGES = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "u", None), (5, "u", ""), (6, "l", "é" * 70000), (7, "x\ny", "<p>one</p>"), (None, "n", "<p>two</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string")
    found = warc.warc_round_trip(spark, pages, least).collect()
    expected = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == body and j is not None]
        top = max(same) if len(body) >= least else i
        own = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected.append((i, len(body), own, "response" if i == top else "revisit", None if i == top else top))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(expected, key=str)
    assert warc.warc_round_trip(spark, pages.limit(0)).collect() == []


def archive(n=40):
    out = io.BytesIO()
    bodies = [f"<html><body>page {i} {'text ' * 50}</body></html>".encode() for i in range(n)]
    warc.write_archive(out, (warc.record(i, f"http://h/{i}", b, warc.digest(b), None, None) for i, b in enumerate(bodies)))
    return out.getvalue(), bodies


def test_archive_frames():
    data, bodies = archive()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME and struct.unpack("<I", data[4:8])[0] > 0
    assert [warc.parsed(f)["payload"] for f in warc.frames(io.BytesIO(data))] == bodies


def test_broken_archives():
    data, _ = archive()
    for broken in (b"", data[:3], b"\x28\xb5\x2f\xfd" + data[4:], data[:100], data[:-3]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(broken)))
    good = warc.record(1, "u", b"body", warc.digest(b"body"), None, None)
    for bad in (good[:-1], good.replace(b"Content-Length: 4\r", b"Content-Length: 5\r"), good.replace(b"body", b"bodx"), good.replace(b"WARC-Date", b"X-Date"), b"WARC/9" + good[8:]):
        with pytest.raises(warc.WarcError):
            warc.parsed(bad)


def test_archive_without_dictionary():
    frame_of = zstandard.ZstdCompressor().compress(b"x")
    data = struct.pack("<II", warc.DICTIONARY_FRAME, 0) + frame_of + frame_of
    assert list(warc.frames(io.BytesIO(data))) == [b"x", b"x"]


def test_pipeline(spark, tmp_path):
    data = [(i, t) for i, t in rows(11) if i is None or i not in (5, 6)]
    item = " ".join(texts(21)[1].split()[:30])
    data += [(70, texts(22)[2] + " " + item + " " + texts(23)[3])]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, counts = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
            ids = {(r.doc_id) for r in docs.collect()}
            assert ids <= {r.doc_id for r in before.collect()}
            counts.append(docs.count())
            if k == 2:
                assert 70 in ids
    assert counts == sorted(counts, reverse=True) and 70 not in ids
    assert {r.doc_id for r in docs.collect()} == ids
    ran = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (str(r.doc_id), r.piece, r.ids_crc32)
    assert sorted(map(key, ran.collect())) == sorted(map(key, docs.collect()))
