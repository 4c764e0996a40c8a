"""SQL of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations


def _direct(s: int) -> str:
    """Cheapest edit of the row in state ``s``: delete, keep or re-role."""
    put = (2, 2, 3, 2)[s]
    name = "user" if put == 2 else "assistant"
    keep = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[s]
    kept = "".join(
        f", CASE WHEN NOT gone AND initial = '{c}' THEN {{'c': f{to}.c + more, 'a': 'K' || f{to}.a, 't': chr(10) || role || ':' || text || f{to}.t}} END" for c, to in keep
    )
    return (
        f"list_min([{{'c': f{s}.c + 2, 'a': 'D' || f{s}.a, 't': f{s}.t}}, "
        f"CASE WHEN NOT gone THEN {{'c': f{put}.c + 1 + more, 'a': 'R' || f{put}.a, 't': chr(10) || '{name}:' || text || f{put}.t}} END{kept}]) AS d{s}"
    )


def _closed(s: int) -> str:
    """The same after up to two insertions."""
    one = (2, 2, 3, 2)[s]
    two = (2, 2, 3, 2)[one]
    name = {2: "user", 3: "assistant"}
    return (
        f"list_min([d{s}, {{'c': d{one}.c + 5, 'a': 'I' || d{one}.a, 't': chr(10) || '{name[one]}:' || d{one}.t}}, "
        f"{{'c': d{two}.c + 10, 'a': 'II' || d{two}.a, 't': chr(10) || '{name[one]}:' || chr(10) || '{name[two]}:' || d{two}.t}}]) AS f{s}"
    )


_REPAIR = f"""
WITH RECURSIVE crcs AS (SELECT list(crc ORDER BY b) AS crc_of FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) t(b))),
given AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT given.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM given, crcs),
ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
hurt AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds JOIN ids ON kinds.conv_id IS NOT DISTINCT FROM ids.conv_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, text, role) AS i,
    rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS shown, left(role, 1) AS initial FROM hurt),
marked AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY g ORDER BY i) AS previous FROM placed),
faults AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS more FROM marked),
counts AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY g),
edits AS (
  SELECT g, n AS i, {{'c': 0, 'a': '', 't': ''}} AS f0, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS f1,
    {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}} AS f2, {{'c': 0, 'a': '', 't': ''}} AS f3 FROM counts
  UNION ALL
  SELECT g, i, {_closed(0)}, {_closed(1)}, {_closed(2)}, {_closed(3)} FROM (
    SELECT faults.g, faults.i - 1 AS i, {_direct(0)}, {_direct(1)}, {_direct(2)}, {_direct(3)} FROM edits JOIN faults ON faults.g = edits.g AND faults.i = edits.i))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.a, '') AS audit,
  sha256(coalesce(substr(f0.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (g) LEFT JOIN (SELECT * FROM edits WHERE i = 0) e USING (g)
"""

_SEARCH = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT d, sum(tf)::BIGINT AS n FROM counts GROUP BY d),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
items AS (SELECT i, item_id, term, count(*) AS c FROM (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total),
scored AS (SELECT i, item_id, doc_id, counts.d, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN docs ON docs.d = counts.d, total GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _gram(size: int) -> str:
    """The window of ``size`` words that starts at a row of ``placed``; null where the text ends before."""
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER following" for k in range(1, size)]])


_SUBSTRINGS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
placed AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS o, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
grams AS (SELECT r, o, i, word, {_gram(13)} AS words FROM placed WINDOW following AS (PARTITION BY r ORDER BY i)),
hits AS (SELECT r, i, word, words IS NOT NULL AND min(o) OVER (PARTITION BY words) < o AS hit FROM grams),
marked AS (SELECT r, i, word, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hits),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM marked),
sums AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
  string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
  coalesce(n_spans, 0)::BIGINT AS n_spans
FROM docs LEFT JOIN sums USING (r)
"""

_QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce({_WORDS}, []) AS w FROM documents),
placed AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
grams AS (SELECT r, i, word, {_gram(5)} AS five, {_gram(10)} AS ten FROM placed WINDOW following AS (PARTITION BY r ORDER BY i)),
starts AS (SELECT r, i, ten, five IS NOT NULL AND count(*) OVER (PARTITION BY r, five) > 1 AS fives, ten IS NOT NULL AND count(*) OVER (PARTITION BY r, ten) > 1 AS tens FROM grams),
inside AS (SELECT r, tens, max(fives) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS by_fives,
  max(tens) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS by_tens FROM starts),
sums AS (SELECT r, count(*) FILTER (by_fives) AS n_repeat_words, count(*) FILTER (by_tens) AS n_covered, count(*) FILTER (tens) AS n_repeats FROM inside GROUP BY r),
again AS (SELECT r, i, ten FROM starts WHERE tens),
diagonal AS (SELECT a.r, b.i - a.i AS apart, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS run
  FROM again a JOIN again b ON a.r = b.r AND a.ten = b.ten AND a.i < b.i),
longest AS (SELECT r, max(n) + 9 AS longest FROM (SELECT r, count(*) AS n FROM diagonal GROUP BY r, apart, run) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_covered, 0)::BIGINT AS n_covered, coalesce(n_repeats, 0)::BIGINT AS n_repeats,
    coalesce(longest, 0)::BIGINT AS longest_repeat
  FROM docs JOIN lines USING (r) LEFT JOIN sums USING (r) LEFT JOIN longest USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_covered::DOUBLE / greatest(n_words, 1)::DOUBLE AS covered_fraction FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND covered_fraction <= 0.15::DOUBLE AND longest_repeat <= 60 AS kept, n_covered, covered_fraction, longest_repeat, n_repeats
FROM judged
"""

_ARCHIVES = """
WITH bodies AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, url, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM bodies)
SELECT page_id, url, payload_bytes, list_reduce(list_transform(range(32), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || substr(hex, (5 * (k // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT & 31) + 1]),
    lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM hashed
"""

SQL = {
    "op6_substring_dedup": _SUBSTRINGS,
    "op8_quality_rules": _QUALITY,
    "op10_warc": _ARCHIVES,
    "op12_conversation_repair": _REPAIR,
    "op13_lexical_search": _SEARCH,
}
