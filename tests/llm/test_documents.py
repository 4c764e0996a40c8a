"""Operators 1, 2, 4, 5 and 8 against brute force."""

import random
import re
import time
import uuid
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxloom.llm import attribution, common, licences, packing, quality, simhash
from voxloom.llm.tokens import Encoder, paths
from tests.llm.corpus import frame, rows


def tokenizer():
    return Tokenizer.from_file(paths()[0])


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_ids_are_the_tokenizers():
    encode, whole = Encoder(*paths()), tokenizer()
    for text in ["", "Hello  wörld\n\n x'll 123 ", "a<|endoftext|>b", "日本語 text", "\x00\x1f"]:
        assert encode.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_counts(spark):
    data = rows()
    found = defaultdict(list)
    for r in attribution.token_counts(frame(spark, data)).collect():
        found[r.doc_id].append(r)
    whole = tokenizer()
    expected = defaultdict(int)
    for i, t in data:
        expected[i] += len(whole.encode(t or "", add_special_tokens=False).ids)
    assert {i: sum(r.n_tokens for r in rs) for i, rs in found.items()} == expected
    for i, t in data:
        if t and "\n" in t and i not in (None, 5, 6):
            lines = {r.section: (r.start, r.end) for r in found[i] if r.section >= 0}
            assert [t.encode()[a:b].decode() for _, (a, b) in sorted(lines.items())] == [x for x in t.split("\n") if x.strip()]


@pytest.mark.parametrize(("rule", "expected"), [("start", [0, 0, -1, 1]), ("end", [0, 1, -1, 1]), ("most", [0, 1, -1, 1])])
def test_allocation_rules(rule, expected):
    # tokens 0-2, 2-6, 6-7 and 7-9; sections 0-3, 3-6 and one from 7 on
    start, end = np.array([0, 3]), np.array([3, 6])
    at, crosses = attribution.allocate(np.array([2, 6, 7]), start, end, rule)
    assert at.tolist() == expected[:3]
    assert crosses.tolist() == [False, True, False]


def fingerprint_by_hand(text, size=4):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    data = rows()
    prints = [fingerprint_by_hand(t) for _, t in data]
    label = list(range(len(data)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(data):
        least[find(k)] = min(x for x in (least.get(find(k)), i) if x is not None) if i is not None or find(k) in least else None
    expected = sorted(((i, f"{prints[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(data)), key=str)
    found = simhash.simhash_groups(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == expected
    assert simhash.simhash_groups(frame(spark, [])).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 4, 8])
def test_near_pairs_finds_all(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63, 30)
    values = {int(v) for v in base}
    for v in base:
        for flips in range(0, 12, 2):
            x = int(v) & (2**64 - 1)
            for b in rng.choice(64, flips, replace=False):
                x ^= 1 << int(b)
            values.add(x - 2**64 if x >= 2**63 else x)
    values = sorted(values)
    expected = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    found = [(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), radius).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101)]
    found = dict(simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}


def test_near_duplicates_out(spark):
    data = rows()
    df = frame(spark, data)
    out = simhash.near_duplicates_out(df)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns
    assert len(set(kept)) == len(kept)
    ids = [i for i, _ in kept]
    assert 3 in ids and 7 not in ids and 4 in ids and 9 not in ids  # copy and near copy
    assert sum(not words(t) for _, t in kept) == 1
    lone = [i for i, t in data if i is not None and all(simhash.similarity((t or "").encode(), (u or "").encode(), 5) < 0.8 for j, u in data if (j, u) != (i, t))]
    assert set(lone) <= set(ids)


def test_near_duplicates_out_links_near_fingerprints(spark):
    """Without bands of minima the fingerprints alone still find a near copy, and none of other texts."""
    words = [f"w{i * 7919 % 9973}" for i in range(1200)]
    a, b, c = " ".join(words[:600]), " ".join([*words[:599], "other"]), " ".join(words[600:])
    prints = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5, 42)) for t in (a, b, c)]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 < (prints[0] ^ prints[2]).bit_count()
    out = simhash.near_duplicates_out(frame(spark, [(1, a), (2, b), (3, c), (4, a)]), bands=0)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_near_duplicates_out_finds_all_near_the_limit(spark):
    rng = random.Random(5)

    def changed(text, at):
        return [*text[:at], f"new{rng.random()}", *text[at + 1 :]]

    data, expected = [], set()
    for i in range(0, 1200, 3):  # a ~ b ~ c with a and c apart, or a ~ b alone
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(50, 62))]
        b = changed(a, 10)
        c = changed(b, 30) if i % 2 else [f"v{rng.randrange(10**6)}" for _ in range(50)]
        group = [" ".join(w).encode() for w in (a, b, c)]
        assert 0.8 <= simhash.similarity(group[0], group[1], 5) <= 0.85 and simhash.similarity(group[0], group[2], 5) < 0.8
        data += [(i + k, t.decode()) for k, t in enumerate(group)]
        expected |= {i} if i % 2 else {i, i + 2}
    found = {r.doc_id for r in simhash.near_duplicates_out(frame(spark, data)).collect()}
    assert found == expected


def test_deltas_lose_no_link(spark):
    """Copies edited in one to five places, all in one band: stars and shared deltas give the components of all pairs."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    sets = []
    for i in range(160):
        copy = list(base if i % 8 else [*base[:75], *(f"x{i}_{k}" for k in range(75))])
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = f"e{rng.randrange(40)}"
        sets.append(np.unique(simhash.shingle_hashes(" ".join(copy).encode(), 5, 42)).view(np.int64).tolist())
    sets[17:20] = [sets[16] + [k, k + 9] for k in range(3)]
    apart = spark.createDataFrame([(b, i, len(s), i) for b in (1, 2) for i, s in enumerate(sets)], "band long, node long, n long, label long")
    delta = simhash._deltas(apart, spark.createDataFrame(list(enumerate(sets)), "node long, hashes array<long>"), 0.8)
    rows = {(r.band, r.node): r for r in delta.collect()}
    assert all(len(set(rows[1, i].delta) ^ set(rows[1, j].delta)) == len(set(sets[i]) ^ set(sets[j])) for i in range(0, 160, 7) for j in range(i))
    similar = lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) - 1e-9

    def label(pairs):
        found = list(range(160))
        for i, j in pairs * 8:
            found[i] = found[j] = min(found[i], found[j])
        for _ in range(160):
            for i, j in pairs:
                found[i] = found[j] = min(found[i], found[j])
        return found

    every = [(i, j) for i in range(160) for j in range(i) if similar(i, j)]
    z = min(range(160), key=lambda i: (rows[1, i].f, i))
    star = [(i, z) for i in range(160) if i != z and rows[1, i].f + rows[1, z].f <= 1e-9]
    assert all(similar(i, j) for i, j in star)
    after = label(star)
    frame_ = spark.createDataFrame([(*r[:3], after[r.node], r.delta, r.f, rows[1, z].f, after[z]) for r in rows.values()], "band long, node long, n long, label long, delta array<long>, f double, fz double, zl long")
    met = [(r.a, r.b) for r in simhash._overlapping(frame_, 0.8).collect()]
    assert label(star + [(i, j) for i, j in met if similar(i, j)]) == label(every)
    apart_pairs = sum(after[i] != after[j] for i in range(160) for j in range(i))
    assert len(met) < apart_pairs / 4


def test_quality(spark):
    data = rows()
    found = sorted(quality.repetition_quality(frame(spark, data)).collect(), key=str)
    expected = []
    for i, t in data:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        where = defaultdict(list)
        for j in range(len(w) - 4):
            where[tuple(w[j : j + 5])].append(j)
        repeated = {j + k for js in where.values() if len(js) > 1 for j in js for k in range(5)}
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        chars = sum(len(x.decode()) for x in w)
        expected.append((i, len(w), chars, len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted(expected, key=str)
    assert all(not r.kept for r in found if r.base_failed)
    assert any(r.kept for r in found)
    assert quality.repetition_quality(frame(spark, [])).collect() == []


def test_only_the_repeats_reject(spark):
    """Below the base rule's share of repeated words, but with long repeats; short ones of the same share stay."""
    rng = random.Random(4)
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    passage, clause = fresh(18), [fresh(6) for _ in range(6)]
    wide = " ".join(fresh(80) + passage + fresh(84) + passage)  # 36 of 200 words
    short = " ".join(w for c in clause for part in (c, fresh(10), c, fresh(20)) for w in part)  # 72 of 252, fails the base
    few = " ".join(fresh(100) + [w for c in clause[:3] for part in (c, fresh(15), c, fresh(15)) for w in part])  # 36 of 226, none of ten words
    long = fresh(61)
    single = " ".join(fresh(700) + long + fresh(200) + long)  # 122 of 1022 words, one repeat of 61
    found = {r.doc_id: r for r in quality.repetition_quality(frame(spark, [(1, wide), (2, short), (3, few), (4, single), (5, " ".join(fresh(300)))])).collect()}
    assert {i: (r.base_failed, r.kept) for i, r in found.items()} == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False), 5: (False, True)}
    assert (found[1].n_covered, found[1].longest_repeat, found[4].longest_repeat) == (36, 18, 61)
    for r in found.values():  # words in ten-word windows found again, by hand
        words = {1: wide, 2: short, 3: few, 4: single}.get(r.doc_id, "").split()
        where = defaultdict(list)
        for j in range(len(words) - 9):
            where[tuple(words[j : j + 10])].append(j)
        assert r.n_covered == len({j + k for js in where.values() if len(js) > 1 for j in js for k in range(10)})


def test_repeats_by_hand():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(0, 30, 3)
        doc, end = np.repeat(np.arange(3), sizes), np.repeat(np.cumsum(sizes), sizes)
        ids = rng.integers(0, 3, sizes.sum())
        best = quality.repeats(ids, doc, end)
        for p in range(len(ids)):
            shared = [0]
            for q in range(len(ids)):
                k = 0
                while q != p and doc[p] == doc[q] and p + k < end[p] and q + k < end[q] and ids[p + k] == ids[q + k]:
                    k += 1
                shared.append(k)
            assert best[p] == max(shared)


def test_licences(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining"
    data = [
        (1, "x All rights reserved. y ALL RIGHTS reserved"), (2, "Licensed under the Apache Licence, Version 2.0"), (3, None), (4, ""),
        (5, notice.replace("hereby", "herebby").replace("charge", "chrge")), (6, "under CC BY-NC 4.0 and cc by"), (None, "GNU General Public License"), (7, "all right is reserved for nobody " * 3),
    ]
    found = {r.doc_id: r for r in licences.licence_scan(frame(spark, data)).collect()}
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels, found[1].score) == (8, 2, 1, 5, "reserved", 1.0)
    assert found[2].labels == "apache-2.0" and 0.9 < found[2].score < 1 and found[2].spans == "apache-2.0:0-7:1"
    assert (found[3].n_words, found[3].labels, found[3].score, found[3].first_word) == (0, "", 0.0, None) == (found[4].n_words, found[4].labels, found[4].score, found[4].first_word)
    assert found[5].labels == "mit" and found[5].n_base == 0
    assert found[6].base_labels == "cc-by" and found[6].n_base == 2
    assert found[None].base_labels == "gpl" and found[None].labels == "gpl"
    assert licences.licence_scan(frame(spark, [])).collect() == []


def test_notices_side_by_side():
    """A worse match before a better one stays, and a long run of notices is searched piece by piece."""
    wanted = licences.notices((("all rights reserved", "reserved"),), licences.CHARS_PER_EDIT)
    worse, better = "all right reserved", "all rights reserved"
    found = licences.scan(f"{worse} {better} x {worse} {worse} {better}".encode(), wanted, base=())
    assert [(first, last, edits) for _, first, last, edits, _ in found["spans"]] == [(0, 2, 1), (3, 5, 0), (7, 9, 1), (10, 12, 1), (13, 15, 0)]
    for text, edits in ((worse, 1), (better, 0)):
        found = licences.scan(f"{text} ".encode() * 5000, wanted)
        assert [(first, last, e) for _, first, last, e, _ in found["spans"]] == [(3 * i, 3 * i + 2, edits) for i in range(5000)]
        assert found["n_base"] == 5000 * (not edits) and found["n_words"] == 15000


def test_best_fit_pack(spark):
    data = rows()
    room = 256
    found = packing.best_fit_pack(frame(spark, data), room).collect()
    whole = tokenizer()
    expected = []
    for i, t in data:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % room or room
        cuts = [0, len(ids)] if len(ids) <= room else [0, *range(head, len(ids) + 1, room)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(expected, key=str)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    assert packing.best_fit_pack(frame(spark, [])).collect() == []


def test_plan_uses_every_piece_and_few_sequences():
    rng = np.random.default_rng(3)
    for room in (10, 50, 100):
        for _ in range(60):
            sizes = rng.integers(1, room + 1, rng.integers(1, 14)).tolist()
            counts = {s: sizes.count(s) for s in set(sizes)}
            fills = packing.plan(dict(counts), room)
            used = defaultdict(int)
            for fill, n in fills:
                assert n > 0 and sum(s * k for s, k in fill) <= room
                for s, k in fill:
                    used[s] += k * n
            assert used == counts
            bins = []  # first fit in descending order
            for s in sorted(sizes, reverse=True):
                k = next((k for k, b in enumerate(bins) if b + s <= room), None)
                if k is None:
                    bins.append(s)
                else:
                    bins[k] += s
            assert sum(n for _, n in fills) <= len(bins)


def optimum(sizes, room):
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted({*range(len(bins))}):
            if bins[b] + sizes[k] <= room:
                bins[b] += sizes[k]
                go(k + 1, bins)
                bins[b] -= sizes[k]
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_reduction_where_three_pieces_fit_beside_the_largest():
    sizes = [28, 22, 9, 9, 4, 4, 4]
    assert optimum(sizes, 40) == 2
    h = packing.Histogram({s: sizes.count(s) for s in set(sizes)})
    fixed = packing.reduced(h, 40)
    rest = [s for s in h.sizes for _ in range(h.left[s])]
    assert sum(n for _, n in fixed) + (optimum(rest, 40) if rest else 0) == 2


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        room = int(rng.integers(5, 30))
        sizes = sorted(rng.integers(1, room + 1, 8).tolist(), reverse=True)
        h = packing.Histogram({s: sizes.count(s) for s in set(sizes)})
        fixed = sum(n for _, n in packing.reduced(h, room))
        rest = [s for s, n in h.left.items() for _ in range(n)]
        assert fixed + (optimum(sorted(rest, reverse=True), room) if rest else 0) == optimum(sizes, room)


def test_near_duplicates_out_leaves_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "something else entirely")], "doc_id long, text string")
    kept = simhash.near_duplicates_out(docs)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["gone"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_shuffles_of_passing_steps_go(spark):
    from voxloom.llm.common import SHUFFLE_CLEANUP, passing, written

    folders = [Path(d.toString()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f.name for d in folders for f in d.glob("*/shuffle_*.data")}
    before, old = held(), spark.conf.get(SHUFFLE_CLEANUP, None)
    with passing(spark):
        assert written(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "counted").count() == 100
        for _ in range(50):
            left = held() - before
            if not left:
                break
            time.sleep(0.1)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == old


def test_joined_labels_by_component(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (5, 2)], "node long, label long")
    links = spark.createDataFrame([(4, 5), (6, 7), (5, 8)], "a long, b long")
    found = {r.node: r.label for r in simhash._joined(labels, links).collect()}
    assert found == {1: 1, 4: 1, 2: 1, 5: 1, 8: 1, 6: 6, 7: 6}
