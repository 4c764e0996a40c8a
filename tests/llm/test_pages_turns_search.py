"""Operators 11 to 13."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from voxloom.llm import conversations, extraction, lexical
from tests.llm.corpus import frame, texts

PROSE = ["The first paragraph of the article, long enough to count as prose.", "A second one & more, with a <b>bold</b> word.", "The third ends it."]
ARTICLE = "Heading\n\nThe first paragraph of the article, long enough to count as prose.\n\nA second one & more, with a bold word.\n\nThe third ends it."


def body(inner_open, inner_close):
    marked = "".join(f"<p>{p.replace('& ', '&amp; ')}</p>" for p in PROSE)
    return f"{inner_open}<h1>Heading</h1>{marked}{inner_close}"


LAYOUTS = {
    "semantic": ("<article>", "</article>"),
    "classes": ("<div class='wrap-12'><div class='post-body entry-77'>", "</div></div>"),
    "table": ("<table><tr><td class=main>", "</td></tr></table>"),
    "sidebar name around": ("<div class='layout sidebar-left'><div id=content>", "</div></div>"),
    "form around": ("<form action=/><div class=text>", "</div></form>"),
}
NOISE = [
    "<nav><a href=/>Home</a><a href=/b>Other</a></nav>",
    "<header>Site name <h1>Logo</h1></header>",
    "<div class='cookie-notice'>We use cookies, and this notice about them is long enough to look like prose.</div>",
    "<div id=adBox>Buy this now, it is cheap and good, and everyone has it already.</div>",
    "<aside>Related reading of some length that is not part of the article.</aside>",
    "<div class='comments'><article class=comment><p>" + "I disagree with everything said above. " * 12 + "</p></article></div>",
    "<form><label>Mail</label><input name=a><button>Go</button></form>",
    "<script>var x = '<p>not text</p>';</script><style>p{margin:0}</style><!-- <p>no</p> -->",
    "<div role=alert>Breaking alert that is no article text at all.</div><p hidden>Hidden paragraph of some length here.</p>",
    "<footer>&copy; Someone, all rights reserved, and some more words for the length.</footer>",
]


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts(name):
    rng = random.Random(name)
    for _ in range(20):
        before, after = rng.sample(NOISE, 4), rng.sample(NOISE, 4)
        html = f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(before)}{body(*LAYOUTS[name])}{''.join(after)}</body></html>"
        assert extraction.extracted(html, {})[0] == ARTICLE, html


def test_broken_pages():
    read = lambda html: extraction.extracted(html, {})[0]
    assert read("<") == "<"
    assert read("") == read("<div") == read("<!-- <p>x</p>") == read("<script>only") == ""
    assert read("just words") == "just words"
    assert read("<p>one<p>two<br>three <b>four<p>five") == "one\n\ntwo three four\n\nfive"
    assert read("<article><p>a &lt;b&gt; &#233;&eacute; &amp&nbsp;\n x</article></b></p>tail") == "a <b> éé & x"
    assert read("<ul><li>first item here<li>second item here</ul>") == "first item here\n\nsecond item here"
    assert read("<article><header><h1>Title</h1><p>By someone</p></header><p>Text &unknown; end.</p></article>") == "Title\n\nText &unknown; end."
    assert read("<div " * 3000 + "<p>x</p>" + "<div>" * 3000 + "deep") != ""
    assert read("<p>" + "word " * 400_000 + "</p>").count("word") == 400_000
    assert read("İ<script>x</SCRIPT>after it") == "İafter it"


def test_hosts_decide(spark):
    """A short article beside a long unnamed column: alone the column wins, the host's other pages put it right."""
    full = "".join(f"<p>{'Article text of a usual page. ' * 8}</p>" for _ in range(4))
    column = "<div class=beta>" + "<p>Text of a column without a telling name.</p>" * 5 + "</div>"
    page = lambda inner: f"<body><div class=alpha><p>{inner}</p></div>{column}</body>"
    odd = page("Only one short line.")
    rows = [(i, f"https://a.example/{i}", page(full)) for i in range(12)] + [(50, "https://A.example:80/x", odd), (51, "https://b.example/x", odd), (52, None, None)]
    rows += [(None, "https://a.example/z", odd), (50, "https://A.example:80/x", odd), (53, "no url", "")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, paths long")
    out = extraction.main_text(df)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    found = out.collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert [r.text for r in by_id[50]] == ["Only one short line."] * 2 == [by_id[None][0].text] * 2
    assert "column" in by_id[51][0].text
    assert by_id[52][0].text == by_id[53][0].text == ""
    # The same votes by hand.
    votes = defaultdict(lambda: defaultdict(list))
    host = lambda u: (re.match(r"\w+://([^/:]*)", u or "") or ["", ""])[1].lower()
    for _, url, html in rows:
        for key, (points, _) in extraction.Page(html or "").candidates().items():
            votes[host(url)][extraction.signed(key)].append(points)
    for page_id, url, html in rows:
        every = sum(map(len, votes[host(url)].values()))
        known = {k: extraction.worth(sum(p), len(p)) for k, p in votes[host(url)].items() if len(p) > 1 and len(p) >= 0.02 * every}
        assert extraction.extracted(html or "", known)[0] in [r.text for r in by_id[page_id]]
    extraction_few, extraction.BROADCAST_PATHS = extraction.BROADCAST_PATHS, 0
    assert sorted(map(str, extraction.main_text(df).collect())) == sorted(map(str, found))
    extraction.BROADCAST_PATHS = extraction_few
    assert extraction.main_text(df.limit(0)).collect() == []


def repaired_by_hand(rows):
    found = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        found[c] += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    for c, turns in found.items():
        turns.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[2], z[1]))
        seen, faults = set(), []
        for _, r, x in turns:
            y = x.strip(" \t\n\v\f\r")
            faults.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "")
            seen.add((r, x))

        @cache
        def best(i, last, added, turns=tuple(turns), faults=tuple(faults)):
            """Cost, letters and lines of the least edits from row ``i`` on; at most three insertions in a row."""
            options = [(0, "", ())] if i == len(turns) and last in ("", "a") else []
            if i < len(turns):
                _, r, x = turns[i]
                more = 5 if faults[i] == "t" else 0
                options.append((2, "D", (), best(i + 1, last, 0)))
                if faults[i] not in ("b", "d"):
                    if (last, r[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                        options.append((more, "K", (f"{r}:{x}",), best(i + 1, r[:1], 0)))
                    name = {"u": "user", "a": "assistant"}[after[last]]
                    options.append((1 + more, "R", (f"{name}:{x}",), best(i + 1, after[last], 0)))
            if added < 3:
                options.append((5, "I", ({"u": "user:", "a": "assistant:"}[after[last]],), best(i, after[last], added + 1)))
            whole = [o if len(o) == 3 else (o[0] + o[3][0], o[1] + o[3][1], o[2] + o[3][2]) for o in options if len(o) == 3 or o[3]]
            return min(whole, key=lambda o: o[:2], default=None)

        cost, audit, lines = best(0, "", 0)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("piece, held", [(1024, 4 << 20), (3, 4 << 20), (2, 40)])
def test_conversation_repair(spark, monkeypatch, piece, held):
    """Against exhaustive edits, with conversations inside tasks, over their edges, and in small pieces."""
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    monkeypatch.setattr(conversations, "HELD_BYTES", held)
    rng = random.Random(piece)
    said = ["a.", "b", "c!", None, "", " \t", "d? \n", "e é", "long enough to matter."]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(said)) for c in [None, *range(40)] for _ in range(rng.randint(1, 20))]
    rows += [(77, rng.choice([None, *range(90)]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice("abc") + str(rng.randint(0, 99)) + rng.choice([".", "", "!"])) for _ in range(250)]
    rows += [(78, 5, "user", "again and again.")] * 60 + [(79, next(t for t in range(99) if zlib.crc32(f"79:{t}".encode()) % 20 == 0), "user", "dropped.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, of string, part long")
    found = conversations.repaired(df)
    expected = repaired_by_hand(rows)
    assert expected[79] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == expected
    assert found.count() == len(expected)
    assert all(re.fullmatch("[DIKR]*", a[6]) for a in expected.values())


def test_conversation_repair_of_nothing(spark):
    assert conversations.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_powers_equal_single_steps():
    for symbol in "sua-":
        for fault in (conversations.OK, conversations.GONE, conversations.CUT):
            end = conversations._LAST
            for n in range(1, 40):
                end = conversations.before(symbol, fault, 1, end)
                assert conversations.before(symbol, fault, n, conversations._LAST) == end
                whole = conversations.table_of([(symbol, fault, n)])
                assert tuple((whole + list(conversations._LAST)).min(axis=1).tolist()) == end


def ranked_by_hand(docs, items):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item_id, text in items:
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scores = []
        for (doc_id, _), w in zip(docs, words, strict=True):
            tf = Counter(w)
            if w:
                m = 75 + 25 * len(w) * n_docs // n_terms
                scores.append((-sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in asked if tf[t]), doc_id is None, doc_id or 0))
        out += [(item_id, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(x for x in scores if x[0])[:20], 1)]
    return out


@pytest.mark.parametrize("cells", [lexical.ITEM_CELLS, 400])
def test_ranked_search(spark, monkeypatch, cells):
    """Against scores of all documents; ties, copies, nulls, and items in several blocks; trees of a few documents too."""
    monkeypatch.setattr(lexical, "ITEM_CELLS", cells)
    rng = random.Random(cells)
    vocabulary = [w for t in texts(5) for w in (t or "").split()]
    docs = [*enumerate(texts(5)), *((100 + i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 30, 200])))) for i in range(400))]
    docs += [(900 + i, "Tie TIE tie, Ünlü") for i in range(30)] + [(None, "tie here"), (3, "tie again"), (3, "tie again")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40])))) for i in range(12)]
    items += [(20, "tie, tie; Ünlü."), (21, None), (22, "--"), (23, "unknownword"), (None, "tie x"), (20, "tie, tie; Ünlü.")]
    found = lexical.ranked(frame(spark, docs), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score long"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, ranked_by_hand(docs, items)))


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert lexical.ranked(frame(spark, []), items).collect() == []
    assert lexical.ranked(frame(spark, [(1, None), (2, "...")]), items).collect() == []
    assert lexical.ranked(frame(spark, [(1, "some words")]), items.limit(0)).collect() == []


def test_search_leaves_subtrees():
    """The search scores far fewer documents than there are, and finds the same."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [(np.unique(rng.integers(0, 12, 3)), None) for _ in range(3000)]
    vectors = [(ids, rng.integers(1, 4, len(ids))) for ids, _ in vectors]
    norms = rng.integers(75, 120, 3000)
    weights = np.zeros((12, 2))
    weights[[0, 3], 0] = 500, 900
    weights[[1, 11, 5], 1] = 300, 2000, 100
    seen = []
    best = lexical.Best(2)
    real, lexical.saturated = lexical.saturated, lambda tf, m: (seen.append(len(tf)), real(tf, m))[1]
    lexical.search(vectors, norms, [-i for i in range(3000)], weights, best)
    lexical.saturated = real
    every = np.stack([real(tfs, m).astype(float) @ weights[ids] for (ids, tfs), m in zip(vectors, norms, strict=True)])
    for item in range(2):
        order = sorted(range(3000), key=lambda d: (-every[d, item], d))[:20]
        assert sorted(best.heaps[item], reverse=True) == [(int(every[d, item]), -d) for d in order]
    assert len(seen) < 2000
