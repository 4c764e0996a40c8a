"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from voxloom.oracle_views import sql

SQL: dict[str, str] = {}

ATTRIBUTED = """
mid AS (SELECT w.recording_id, w.pos, arg_min(s.speaker_id, s.seg_no) AS m FROM words w JOIN segments s
  ON s.recording_id = w.recording_id AND (w.start_time + w.end_time) / 2 BETWEEN s.start_time AND s.end_time GROUP BY ALL),
ovl AS (SELECT recording_id, pos, speaker_id AS o FROM (
  SELECT w.recording_id, w.pos, s.speaker_id, row_number() OVER (PARTITION BY w.recording_id, w.pos
    ORDER BY least(w.end_time, s.end_time) - greatest(w.start_time, s.start_time) DESC, s.seg_no) AS k
  FROM words w JOIN segments s ON s.recording_id = w.recording_id
   AND least(w.end_time, s.end_time) - greatest(w.start_time, s.start_time) > 0) WHERE k = 1),
spoken AS (SELECT w.*, m, o, coalesce(m, o, 'SPEAKER_UNKNOWN') AS speaker_id FROM words w
  LEFT JOIN mid USING (recording_id, pos) LEFT JOIN ovl USING (recording_id, pos)),
"""

# One-word spikes: odd places inside runs of candidates take the left neighbour.
SMOOTHED = ATTRIBUTED + """
near AS (SELECT *, lag(speaker_id) OVER r AS p, lead(speaker_id) OVER r AS n FROM spoken WINDOW r AS (PARTITION BY recording_id ORDER BY pos)),
cand AS (SELECT *, coalesce(p = n AND speaker_id <> p, FALSE) AS c FROM near),
runs AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY pos) AS g FROM cand),
smooth AS (SELECT recording_id, pos, word, start_time, end_time,
  CASE WHEN c AND sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, g ORDER BY pos) % 2 = 1 THEN p ELSE speaker_id END AS speaker_id FROM runs),
"""

FUSED = SMOOTHED + """
flagged AS (SELECT *, CASE WHEN lag(speaker_id) OVER r IS NULL OR speaker_id <> lag(speaker_id) OVER r OR start_time - lag(end_time) OVER r > 1.5 THEN pos END AS b
  FROM smooth WINDOW r AS (PARTITION BY recording_id ORDER BY pos)),
sess AS (SELECT *, max(b) OVER (PARTITION BY recording_id ORDER BY pos) AS utt_key FROM flagged),
built AS (SELECT recording_id, utt_key, min(speaker_id) AS speaker_id, arg_min(start_time, pos) AS start_time, arg_max(end_time, pos) AS end_time,
  string_agg(word, ' ' ORDER BY pos) AS text FROM sess GROUP BY recording_id, utt_key),
seen AS (SELECT recording_id, speaker_id, row_number() OVER (PARTITION BY recording_id ORDER BY min(utt_key)) - 1 AS k
  FROM built WHERE speaker_id <> 'SPEAKER_UNKNOWN' GROUP BY recording_id, speaker_id),
fused AS (SELECT b.recording_id, utt_key, CASE WHEN k IS NULL THEN b.speaker_id ELSE 'SPEAKER_' || lpad(k::VARCHAR, 2, '0') END AS speaker_id,
  start_time, end_time, text FROM built b LEFT JOIN seen USING (recording_id, speaker_id)),
"""

SQL["word_times"] = sql("words", "SELECT recording_id, pos, round((start_time + end_time) / 2, 6) AS midpoint, round(end_time - start_time, 6) AS duration FROM words")
SQL["speaker_at_midpoint"] = sql("segments", "SELECT recording_id, pos, m AS speaker_id FROM spoken", ATTRIBUTED)
SQL["max_overlap_speaker"] = sql("segments", "SELECT recording_id, pos, speaker_id FROM spoken WHERE m IS NULL", ATTRIBUTED)
SQL["vad_filter"] = sql("words intervals", """
SELECT recording_id, pos, word FROM words w WHERE NOT EXISTS (SELECT 1 FROM intervals v WHERE v.recording_id = w.recording_id)
 OR EXISTS (SELECT 1 FROM intervals v WHERE v.recording_id = w.recording_id AND (w.start_time + w.end_time) / 2 BETWEEN v.start_time - 0.6 AND v.end_time + 0.6)""")
PAIRS = """
pairs AS (SELECT a.recording_id, a.seg_no AS i_seg, b.seg_no AS j_seg, a.start_time AS i_start, b.start_time AS j_start,
  least(a.speaker_id, b.speaker_id) AS s1, greatest(a.speaker_id, b.speaker_id) AS s2,
  greatest(a.start_time, b.start_time) AS lo, least(a.end_time, b.end_time) AS hi
 FROM segments a JOIN segments b ON a.recording_id = b.recording_id AND a.speaker_id <> b.speaker_id
  AND (a.start_time < b.start_time OR (a.start_time = b.start_time AND a.seg_no < b.seg_no)) AND b.start_time < a.end_time
  AND least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time) > 0.05),
"""
# printf rounds the exact binary value, like the operator.
R2 = "CAST(printf('%.2f', {}) AS DOUBLE)"
SQL["overlap_pairs"] = sql("segments", f"""
SELECT recording_id, i_seg, j_seg, s1 || '+' || s2 AS speakers, {R2.format('lo')} AS start_time, {R2.format('hi')} AS end_time,
 {R2.format('hi - lo')} AS duration FROM pairs""", PAIRS)
SQL["smooth_speakers"] = sql("segments", "SELECT recording_id, pos, speaker_id FROM smooth", SMOOTHED)
SQL["sessionise_words"] = sql("words", """
SELECT recording_id, pos, max(b) OVER (PARTITION BY recording_id ORDER BY pos) AS utt_key FROM (
 SELECT recording_id, pos, CASE WHEN lag(role) OVER r IS NULL OR role <> lag(role) OVER r OR start_time - lag(end_time) OVER r > 1.5 THEN pos END AS b
 FROM words WINDOW r AS (PARTITION BY recording_id ORDER BY pos))""")
SQL["build_utterances"] = sql("words", """
SELECT recording_id, pos // 23 AS utt_key, arg_min(start_time, pos) AS start_time, arg_max(end_time, pos) AS end_time,
 string_agg(trim(word), ' ' ORDER BY pos) AS text FROM words GROUP BY recording_id, pos // 23""")
SQL["normalise_speakers"] = sql("segments", """
SELECT recording_id, seg_no AS utt_key, 'SPEAKER_' || lpad((dense_rank() OVER (PARTITION BY recording_id ORDER BY f) - 1)::VARCHAR, 2, '0') AS speaker_id
FROM (SELECT *, min(seg_no) OVER (PARTITION BY recording_id, speaker_id) AS f FROM segments)""")
SQL["suppress_repeats"] = sql("words", """
SELECT recording_id, pos, word FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, g ORDER BY pos) AS k FROM (
 SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY pos) AS g FROM (
  SELECT *, CASE WHEN lower(word) = lag(lower(word)) OVER (PARTITION BY recording_id ORDER BY pos) THEN 0 ELSE 1 END AS f FROM said))) WHERE k <= 2""",
"""said AS (SELECT recording_id, word, row_number() OVER (PARTITION BY recording_id ORDER BY p, k) - 1 AS pos FROM (
 SELECT recording_id, pos AS p, word, unnest(range(CASE WHEN pos % 7 = 0 THEN 4 ELSE 1 END)) AS k FROM words))""")
SQL["fuse"] = sql("segments", "SELECT recording_id, utt_key, speaker_id, start_time, end_time, text FROM fused", FUSED)

SQL["fusion_unattributed"] = sql("words", """
SELECT recording_id, utt_key, 'SPEAKER_UNKNOWN' AS speaker_id, arg_min(start_time, pos) AS start_time, arg_max(end_time, pos) AS end_time,
 string_agg(word, ' ' ORDER BY pos) AS text FROM (
 SELECT *, max(b) OVER (PARTITION BY recording_id ORDER BY pos) AS utt_key FROM (
 SELECT *, CASE WHEN lag(pos) OVER r IS NULL OR start_time - lag(end_time) OVER r > 1.5 THEN pos END AS b
 FROM words WINDOW r AS (PARTITION BY recording_id ORDER BY pos))) GROUP BY recording_id, utt_key""")

DUR = """
dur AS (SELECT r.*, CASE WHEN duration_seconds > 0 THEN duration_seconds ELSE coalesce(
  (SELECT max(end_time) FROM words w WHERE w.recording_id = r.recording_id), (SELECT max(end_time) FROM segments s WHERE s.recording_id = r.recording_id), 0.0) END AS effective_duration
 FROM recordings r),
"""
SUMMARY = DUR + PAIRS + f"""
tot AS (SELECT recording_id, sum(hi - lo) AS t, count(*) AS c FROM pairs GROUP BY recording_id),
summ AS (SELECT d.*, FALSE AS supported, {R2.format('coalesce(t, 0.0)')} AS total_overlap_seconds,
 CASE WHEN effective_duration > 0 THEN {R2.format('coalesce(t, 0.0) / effective_duration * 100')} ELSE 0.0 END AS overlap_percentage,
 CAST(coalesce(c, 0) AS INTEGER) AS interrupt_count FROM dur d LEFT JOIN tot USING (recording_id)),
"""
SQL["effective_duration"] = sql("segments recordings", "SELECT recording_id, effective_duration FROM dur", DUR)
SQL["overlap_summary"] = sql("segments recordings", "SELECT recording_id, supported, total_overlap_seconds, overlap_percentage, interrupt_count FROM summ", SUMMARY)
SQL["overlap_pages"] = sql("segments", f"""
SELECT recording_id, page_no, CAST(to_json(list({{'speakers': [s1, s2], 'start_time': {R2.format('lo')}, 'end_time': {R2.format('hi')}, 'duration': {R2.format('hi - lo')}}}
 ORDER BY k)) AS VARCHAR) AS overlaps
FROM (SELECT *, (k - 1) // 1000 AS page_no FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY i_start, i_seg, j_start, j_seg) AS k FROM pairs))
GROUP BY recording_id, page_no""", PAIRS)
SQL["summary_json"] = sql("segments recordings", """
SELECT recording_id, CASE WHEN recording_id % 5 = 0 THEN left(j, length(j) - 1) ELSE j END AS json,
 CASE WHEN recording_id % 5 <> 0 THEN total_overlap_seconds END AS total_overlap_seconds, CASE WHEN recording_id % 5 <> 0 THEN interrupt_count END AS interrupt_count
FROM (SELECT *, CAST(to_json({'supported': supported, 'total_overlap_seconds': total_overlap_seconds, 'overlap_percentage': overlap_percentage, 'interrupt_count': interrupt_count}) AS VARCHAR) AS j FROM summ)""", SUMMARY)
SQL["diarise_gate"] = sql("segments recordings", "SELECT recording_id, CASE WHEN num_speakers = 1 THEN 'single' WHEN duration_seconds < 45 THEN 'short' ELSE 'diarise' END AS gate FROM recordings")
SQL["single_speaker_segments"] = sql("recordings", """
SELECT recording_id, 0::BIGINT AS seg_no, 'SPEAKER_00' AS speaker_id, 0.0::DOUBLE AS start_time, CASE WHEN duration_seconds > 0 THEN duration_seconds ELSE 1000.0 END AS end_time
FROM recordings WHERE num_speakers = 1""")
SQL["validate_inputs"] = sql("segments", """SELECT count(*) AS n, count(*) FILTER (recording_id IS NULL OR seg_no IS NULL OR speaker_id IS NULL) AS null_keys,
 count(*) FILTER (start_time > end_time) AS reversed FROM segments""")

# Runs of equal words and comma parts as list islands. Phrases never repeat three times in this table.
def collapse(items: str) -> str:
    """Items kept: all but the 2nd, 3rd... of runs of three or more."""
    return (
        f"list_filter({items}, lambda x, i: NOT coalesce(i > 1 AND lower({items}[i-1]) = lower(x) AND "
        f"((i > 2 AND lower({items}[i-2]) = lower(x)) OR lower({items}[i+1]) = lower(x)), FALSE))"
    )


def clean(source: str, keys: str, carry: str = "") -> str:
    return f"""
c1 AS (SELECT {keys}, {carry} text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM {source}),
c2 AS (SELECT {keys}, {carry} text, array_to_string({collapse('ws')}, ' ') AS t FROM c1),
c3 AS (SELECT {keys}, {carry} text, t, list_filter(list_transform(string_split(t, ','), lambda p: trim(p)), lambda p: p <> '') AS ps FROM c2),
cleaned AS (SELECT {keys}, {carry} CASE WHEN trim(text) = '' THEN text WHEN len(ps) = 0 THEN t ELSE array_to_string({collapse('ps')}, ', ') END AS text FROM c3),
"""


def turkish(text: str) -> str:
    # Day names.
    days = "pazartesi|salı|çarşamba|perşembe|cuma|cumartesi|pazar"
    # RE2 has no look-around and an ASCII word boundary: boundaries are spelled out as blanks and punctuation.
    edge = "(^|[ .,?!:;])"
    tail = "([ .,?!:;]|$)"
    out = f"regexp_replace({text}, '\\s+([?!,.:;])', '\\1', 'g')"
    out = f"regexp_replace({out}, '{edge}({days})(günü|gün|sabahı|akşamı){tail}', '\\1\\2 \\3\\4', 'gi')"
    for word, right in (
        ("bir\\s+beyni", "bir beğeni"),
        ("arkadaşıar", "Arkadaşlar"),
        ("tüpçeyi", "Türkçeyi"),
        ("tüpçe", "Türkçe"),
        ("akıcık", "Akıcı"),
    ):
        out = f"regexp_replace({out}, '{edge}{word}{tail}', '\\1{right}\\2', 'gi')"
    return out


SQL["clean_repetition"] = sql("utterances", "SELECT recording_id, utt_no, text FROM cleaned", clean("utterances", "recording_id, utt_no"))
SQL["normalise_turkish"] = sql("utterances", f"""
SELECT recording_id, utt_no, {turkish("concat(text, ' Cumagünü geldi , bir  beyni tüpçe akıcık arkadaşıar salısabahı !')")} AS text FROM utterances""")

TRIGGERS = [
    # Role triggers.
    "buyurun", "müşteri hizmetleri", "nasıl yardımcı olabilirim", "anladım hanımefendi", "anladım beyefendi", "anladım efendim",
    "şikayetinizi not aldım", "size geri dönüş yapacağız", "merhaba ben", "şikayetim var", "sorunlar yaşıyorum", "iade edilmesini talep ediyorum",
]


def roles(source: str, triggers: list[str], keys: str = "recording_id, utt_no") -> str:
    at = ", ".join(f"CASE WHEN instr(lower(s), '{t}') > 10 THEN instr(lower(s), '{t}') END" for t in triggers)
    other = "CASE WHEN speaker_id = 'SPEAKER_00' THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END"
    cut = R2.format("start_time + (end_time - start_time) * (length(h)::DOUBLE / length(s))")
    return f"""
r1 AS (SELECT *, coalesce({at}, 0) AS cutp FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM {source})),
r2 AS (SELECT *, rtrim(left(s, cutp - 1), E' \\n\\t\\r') AS h, substring(s, cutp) AS tl FROM r1 WHERE cutp > 0),
r3 AS (SELECT {keys}, speaker_id, start_time, end_time, h, tl, {cut} AS c FROM r2),
split AS (SELECT {keys}, 0::BIGINT AS part, speaker_id, start_time, end_time, text FROM r1 WHERE cutp = 0
 UNION ALL SELECT {keys}, 0, speaker_id, start_time, c, h FROM r3
 UNION ALL SELECT {keys}, 1, {other}, c, end_time, tl FROM r3),
"""


SQL["split_role_transition"] = sql("utterances", "SELECT recording_id, utt_no, part, speaker_id, start_time, end_time, text FROM split", roles("utterances", TRIGGERS))
SQL["custom_triggers"] = sql("utterances", "SELECT recording_id, utt_no, part, speaker_id, text FROM split", roles("utterances", ["neden gecikti", "devam ediyoruz"]))
# Pieces as rows; the rounded clock is a recursive walk over them.
SQL["split_questions"] = sql("utterances", f"""
SELECT recording_id, utt_no, k - 1 AS sub, CASE WHEN k % 2 = 1 THEN speaker_id WHEN speaker_id = 'SPEAKER_00' THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END AS speaker_id,
 {R2.format('t0')} AS start_time, CASE WHEN k = len(segs) THEN end_time ELSE t1 END AS end_time, segs[k] AS text FROM walk
UNION ALL SELECT recording_id, utt_no, 0, speaker_id, start_time, end_time, text FROM q2 WHERE len(segs) <= 1 OR s NOT LIKE '%?%'
""", f"""q1 AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM utterances),
q2 AS (SELECT *, list_filter(list_transform(regexp_extract_all(s, '[^?]+\\?*|\\?+'), lambda p: CASE WHEN regexp_full_match(p, '\\s*\\?+') THEN trim(p)
  ELSE regexp_replace(regexp_replace(p, '\\?+$', ''), '^\\s+|\\s+$', '', 'g') || CASE WHEN p LIKE '%?' THEN '?' ELSE '' END END), lambda p: p <> '') AS segs FROM q1),
walk AS (WITH RECURSIVE w AS (
 SELECT recording_id, utt_no, speaker_id, start_time, end_time, s, segs, 1 AS k, start_time AS t0, {R2.format('start_time + length(segs[1])::DOUBLE / length(s) * (end_time - start_time)')} AS t1
 FROM q2 WHERE len(segs) > 1 AND s LIKE '%?%'
 UNION ALL SELECT recording_id, utt_no, speaker_id, start_time, end_time, s, segs, k + 1, t1, {R2.format('t1 + length(segs[k + 1])::DOUBLE / length(s) * (end_time - start_time)')}
 FROM w WHERE k < len(segs)) SELECT * FROM w)""")


def merged(source: str, order: str) -> str:
    strip = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    return f"""
m1 AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY {order}) - 1 AS idx, {strip} AS bare FROM {source}),
m2 AS (SELECT *, CASE WHEN coalesce(speaker_id = lag(speaker_id) OVER r AND start_time - lag(end_time) OVER r <= 1.5 AND bare <> '' AND lag(bare) OVER r <> '', FALSE) THEN NULL ELSE idx END AS b
 FROM m1 WINDOW r AS (PARTITION BY recording_id ORDER BY idx)),
m3 AS (SELECT *, max(b) OVER (PARTITION BY recording_id ORDER BY idx) AS seq FROM m2),
joined AS (SELECT recording_id, seq, arg_min(speaker_id, idx) AS speaker_id, arg_min(start_time, idx) AS start_time, arg_max(end_time, idx) AS end_time,
 CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg(bare, ' ' ORDER BY idx) END AS text FROM m3 GROUP BY recording_id, seq),
"""


SQL["merge_short_gaps"] = sql("utterances", "SELECT * FROM joined", merged("utterances", "utt_no"))
# Greetings.
GREET = "(lower(text) LIKE '%müşteri hizmetleri%' OR lower(text) LIKE '%hizmetleri birimi%' OR lower(text) LIKE '%hoş geldiniz%' OR lower(text) LIKE '%çağrı merkezi%' OR lower(text) LIKE '%temsilciniz%')"


def locked(source: str, order: str, cols: str, horizon: float) -> str:
    return f"""
g1 AS (SELECT *, row_number() OVER r - 1 AS gi, max(start_time) OVER r <= {horizon} AND {GREET} AS hit FROM {source} WINDOW r AS (PARTITION BY recording_id ORDER BY {order})),
g2 AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY recording_id) AS k, max(gi) FILTER (hit) OVER (PARTITION BY recording_id) AS mx FROM g1),
g3 AS (SELECT *, CASE WHEN k >= 2 AND mx = k - 1 AND gi < k THEN 0 ELSE gi END AS g FROM g2),
locked AS (SELECT recording_id, {', '.join(f'arg_min({c}, gi) AS {c}' for c in cols.split())}, arg_min(speaker_id, gi) AS speaker_id, arg_min(start_time, gi) AS start_time, arg_max(end_time, gi) AS end_time,
 CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY gi) END AS text FROM g3 GROUP BY recording_id, g),
"""


SQL["lock_greetings"] = sql("utterances", "SELECT * FROM locked", locked("utterances", "utt_no", "utt_no", 90.0))
CLEAN_ALL = clean("utterances", "recording_id, utt_no", "speaker_id, start_time, end_time,")
TURKISH_ALL = f"tidy AS (SELECT recording_id, utt_no, speaker_id, start_time, end_time, {turkish('text')} AS text FROM cleaned),"
SQL["refine_general"] = sql("utterances", "SELECT * FROM joined", CLEAN_ALL + TURKISH_ALL + merged("tidy", "utt_no"))
SQL["refine_call_center"] = sql("utterances", "SELECT * FROM joined",
    CLEAN_ALL + TURKISH_ALL + roles("tidy", TRIGGERS) + locked("split", "utt_no, part", "utt_no part", 90.0) + merged("locked", "utt_no, part"))

# The whole analysis: gated segments and filtered words take the place of the raw tables.
ANALYSE = ("""
all_words AS (SELECT * FROM words), all_segments AS (SELECT * FROM segments),
kept AS (SELECT * FROM all_words w WHERE NOT EXISTS (SELECT 1 FROM intervals v WHERE v.recording_id = w.recording_id)
 OR EXISTS (SELECT 1 FROM intervals v WHERE v.recording_id = w.recording_id AND (w.start_time + w.end_time) / 2 BETWEEN v.start_time - 0.6 AND v.end_time + 0.6)),
used AS (SELECT s.* FROM all_segments s JOIN recordings r USING (recording_id) WHERE r.num_speakers <> 1
 UNION ALL SELECT recording_id, 0, 'SPEAKER_00', 0.0, CASE WHEN duration_seconds > 0 THEN duration_seconds ELSE 1000.0 END FROM recordings WHERE num_speakers = 1),
""", lambda text: text.replace("FROM words", "FROM kept").replace("JOIN segments", "JOIN used").replace("FROM segments", "FROM used"))
SQL["analyse"] = sql("segments intervals recordings", "SELECT * FROM joined",
    ANALYSE[0] + ANALYSE[1](FUSED) + "src AS (SELECT recording_id, utt_key AS utt_no, speaker_id, start_time, end_time, text FROM fused),"
    + clean("src", "recording_id, utt_no", "speaker_id, start_time, end_time,") + TURKISH_ALL + merged("tidy", "utt_no"))
SQL["analyse_summaries"] = sql("segments intervals recordings", """
SELECT recording_id, CASE WHEN num_speakers = 1 THEN 'single' ELSE 'diarise' END AS gate, effective_duration, total_overlap_seconds, overlap_percentage, interrupt_count FROM summ""",
    ANALYSE[0] + ANALYSE[1](SUMMARY))

PROMPT = ("Aşağıdaki konuşma dökümünde konuşmacı geçişlerini kontrol et:\n\n", "\n\nDüzeltilmiş konuşmacı bloklarını formatla.")
SQL["render_prompt"] = sql("utterances", f"""
SELECT recording_id, 0::BIGINT AS page_no, '{PROMPT[0]}' || string_agg(speaker_id || ': ' || text, chr(10) ORDER BY utt_no) || '{PROMPT[1]}' AS prompt FROM utterances GROUP BY recording_id""")
SQL["transcript_json"] = sql("utterances", """
SELECT recording_id, 0::BIGINT AS page_no, CAST(to_json(list({'speaker': speaker_id, 'start': start_time, 'end': end_time, 'text': text} ORDER BY utt_no)) AS VARCHAR) AS transcript
FROM utterances GROUP BY recording_id""")
SQL["transcript_lines"] = sql("utterances", """
SELECT recording_id, utt_no, printf('[%05.2fs - %05.2fs] %-12s : ', start_time, end_time, speaker_id) || text AS line FROM utterances""")

# --- job tables ---
IPS = """
ips AS (SELECT *, job_id % 256 AS a, (job_id // 3) % 256 AS b, (job_id // 7) % 251 AS c, (job_id // 11) % 241 AS d, (job_id // 5) % 256 AS e, (job_id // 2) % 256 AS f FROM jobs),
"""


def public(a: str, b: str, c: str) -> str:
    return (
        f"NOT ({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) "
        f"OR ({a} = 192 AND {b} = 0 AND {c} IN (0, 2)) OR ({a} = 198 AND {b} IN (18, 19)) OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113))"
    )


IP_OK = f"(job_id % 17 <> 0 AND {public('a', 'b', 'c')} AND (job_id % 2 = 0 OR {public('e', 'f', '9')}))"
SQL["admission"] = sql("jobs", f"""
SELECT job_id, reason, CASE WHEN reason IS NULL THEN 202 WHEN reason = 'too_large' THEN 413 ELSE 400 END AS code FROM (
SELECT job_id, CASE WHEN num_speakers NOT BETWEEN 1 AND 10 THEN 'num_speakers' WHEN job_id % 7 IN (5, 6) THEN 'extension' WHEN size_bytes > 104857600 THEN 'too_large'
 WHEN size_bytes = 0 THEN 'empty' WHEN callback_url IS NOT NULL AND NOT {IP_OK} THEN 'callback_url' WHEN job_id % 11 = 0 THEN 'content' END AS reason FROM ips)""", IPS)
SQL["callback_policy"] = sql("jobs", f"""
SELECT job_id, CASE WHEN job_id % 4 = 0 THEN FALSE WHEN callback_url IS NULL THEN TRUE ELSE {IP_OK} END AS allowed FROM ips""", IPS)
SQL["error_class"] = sql("jobs", """
SELECT job_id, CASE job_id % 5 WHEN 3 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE (job_id // 5) % 4 IN (1, 3) END AS transient FROM jobs""")
SQL["error_sanitise"] = sql("jobs", r"""
SELECT job_id, 'OSError: ' || regexp_replace(regexp_replace('cannot open /srv/data/' || job_id || '/a.wav: or C:\Users\x\' || job_id || '.wav now, see /tmp and a/b/c',
 '[A-Za-z]:\\[^\s:]+', '[FILE_PATH]', 'g'), '/(?:[^\s:]+/)+[^\s:]+', '[FILE_PATH]', 'g') AS message FROM jobs""")
SQL["storage_uri_parts"] = sql("jobs", """
SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 's3' ELSE 'disk' END AS scheme, CASE WHEN job_id % 5 = 0 THEN 'bucket' || (job_id % 3) END AS bucket,
 CASE job_id % 5 WHEN 0 THEN 'raw/' || job_id WHEN 1 THEN '../' || job_id ELSE job_id || '.wav' END AS key, job_id % 5 <> 1 AS safe,
 CASE WHEN job_id % 7 = 6 THEN '.bin' ELSE lower(regexp_extract(file_name, '\\.[A-Za-z0-9]+$')) END AS ext FROM jobs""")
SQL["idempotent_ingest"] = sql("jobs", """
SELECT job_id, coalesce(CASE WHEN external_id IS NOT NULL THEN win END, job_id) AS effective_id, external_id IS NULL OR (NOT stored AND win = job_id) AS is_new
FROM (SELECT *, first_value(job_id) OVER (PARTITION BY external_id ORDER BY r, created_at, job_id) AS win, first_value(r) OVER (PARTITION BY external_id ORDER BY r, created_at, job_id) = 0 AS stored
 FROM (SELECT *, (job_id // 1000) % 2 AS r FROM jobs)) WHERE r = 1""")
SQL["backfill_records"] = sql("jobs", "SELECT job_id, status FROM jobs WHERE (job_id // 50) % 2 = 1")
SQL["backfill_utterances"] = sql("jobs stored", "SELECT recording_id, utterance_id FROM stored JOIN jobs ON job_id = recording_id WHERE (job_id // 50) % 2 = 1")
SQL["record_with_utterances"] = sql("jobs stored", """
SELECT job_id AS recording_id, status, 0::BIGINT AS page_no, coalesce((SELECT string_agg(utterance_id, ',' ORDER BY start_time, created_no, utterance_id) FROM stored s WHERE s.recording_id = job_id), '') AS ids FROM jobs""")
GONE = "gone AS (SELECT job_id FROM jobs WHERE status = 'FAILED' OR job_id % 9 = 0)"
SQL["cascade_delete_jobs"] = sql("jobs", "SELECT job_id, status FROM jobs WHERE job_id NOT IN (SELECT job_id FROM gone)", GONE)
SQL["cascade_delete_utterances"] = sql("jobs stored", "SELECT recording_id, utterance_id FROM stored WHERE recording_id NOT IN (SELECT job_id FROM gone)", GONE)
SQL["cascade_delete_deliveries"] = sql("jobs deliveries", "SELECT delivery_id, job_id FROM deliveries WHERE job_id NOT IN (SELECT job_id FROM gone)", GONE)
DONE = """
state AS (SELECT *, CASE WHEN job_id % 6 <> 0 THEN updated_at END AS p FROM jobs),
res AS (SELECT job_id + CASE WHEN job_id % 13 = 0 THEN 1000000000 ELSE 0 END AS job_id, job_id AS k,
 CASE job_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '1998-01-01' ELSE updated_at END AS token, CASE WHEN job_id % 2 = 0 THEN 'tr' END AS language FROM jobs),
verdicts AS (SELECT r.*, CASE WHEN status IS NULL THEN 'missing' WHEN status NOT IN ('COMPLETED', 'PROCESSING') OR NOT (token IS NULL OR p IS NULL OR token = p) THEN 'stale'
 WHEN status = 'COMPLETED' THEN 'already_done' ELSE 'applied' END AS verdict FROM res r LEFT JOIN state s ON s.job_id = r.job_id),
"""
SQL["fenced_complete"] = sql("jobs", "SELECT job_id, verdict FROM verdicts", DONE)
SQL["fenced_complete_jobs"] = sql("jobs", """
SELECT s.job_id, CASE WHEN v.k IS NULL THEN status ELSE 'COMPLETED' END AS status, CASE WHEN v.k IS NULL THEN updated_at ELSE TIMESTAMP '1998-01-01' END AS updated_at, v.language,
 CASE WHEN v.k IS NULL THEN 'old' END AS error_message FROM state s LEFT JOIN (SELECT * FROM verdicts WHERE verdict = 'applied') v USING (job_id)""", DONE)
SQL["fenced_complete_outbox"] = sql("jobs", """
SELECT s.job_id, callback_url AS url, 'p' || v.k AS payload, 0 AS attempts, TIMESTAMP '1998-01-01' AS next_attempt_at, 'PENDING' AS status
FROM state s JOIN verdicts v USING (job_id) WHERE verdict = 'applied' AND callback_url IS NOT NULL""", DONE)
SQL["fenced_complete_utterances"] = sql("jobs stored", """
SELECT recording_id, CASE WHEN recording_id IN (SELECT job_id FROM verdicts WHERE verdict = 'applied') THEN 'new-' ELSE '' END || utterance_id AS utterance_id FROM stored""", DONE)
ENGINES = """
tagged AS (SELECT *, CASE speaker_id WHEN 'SPK_system' THEN 'alpha' WHEN 'SPK_noise' THEN 'beta' ELSE 'gamma' END AS engine FROM segments),
raised AS (SELECT recording_id, 'alpha' AS engine FROM recordings WHERE recording_id % 3 = 0 UNION ALL SELECT recording_id, 'beta' FROM recordings WHERE recording_id % 7 = 0),
good AS (SELECT DISTINCT recording_id, engine FROM tagged EXCEPT SELECT * FROM raised),
win AS (SELECT r.recording_id, min(engine) AS engine FROM recordings r LEFT JOIN good USING (recording_id) GROUP BY r.recording_id),
tried AS (SELECT w.recording_id, e.* FROM win w, (VALUES ('alpha', 'beta'), ('beta', 'gamma'), ('gamma', 'None')) e(f, t) WHERE w.engine IS NULL OR e.f < w.engine),
skips AS (SELECT t.recording_id, f AS from_engine, t.t AS to_engine, CASE WHEN r.engine IS NOT NULL THEN 'exception' ELSE 'empty_result' END AS reason
 FROM tried t LEFT JOIN raised r ON r.recording_id = t.recording_id AND r.engine = t.f),
"""
SQL["engine_fallback"] = sql("segments recordings", "SELECT recording_id, engine FROM win", ENGINES)
SQL["engine_fallback_segments"] = sql("segments recordings", "SELECT t.recording_id, seg_no, engine FROM tagged t JOIN win USING (recording_id, engine)", ENGINES)
SQL["engine_skip_log"] = sql("segments recordings", "SELECT * FROM skips", ENGINES)
SQL["fallback_counts"] = sql("segments recordings", "SELECT from_engine, to_engine, reason, count(*) AS n FROM skips GROUP BY ALL", ENGINES)
SQL["utterance_ordinals"] = sql("stored", "SELECT recording_id, utterance_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_time, created_no, utterance_id) - 1 AS utt_no FROM stored")
SQL["list_jobs"] = sql("jobs stored", """
SELECT job_id AS recording_id, created_at, CAST((SELECT count(*) FROM stored s WHERE s.recording_id = job_id) AS INTEGER) AS n
FROM (SELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 20)""")
SQL["due_deliveries"] = sql("deliveries", "SELECT delivery_id, url, next_attempt_at FROM deliveries WHERE status = 'PENDING' AND next_attempt_at <= TIMESTAMP '1998-01-01' ORDER BY next_attempt_at, delivery_id LIMIT 50")
SQL["stale_jobs"] = sql("jobs", "SELECT job_id, updated_at FROM jobs WHERE status = 'PROCESSING' AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 1800 SECOND ORDER BY updated_at, job_id LIMIT 50")
SQL["expired_jobs"] = sql("jobs", "SELECT job_id, status FROM jobs WHERE created_at < TIMESTAMP '1998-01-01' AND status IN ('COMPLETED', 'FAILED') ORDER BY created_at, job_id LIMIT 100")
SQL["fifo_capacity"] = sql("jobs", """
SELECT job_id, size_bytes FROM (SELECT *, row_number() OVER r AS n, sum(size_bytes) OVER r AS b FROM jobs WINDOW r AS (ORDER BY created_at DESC, job_id DESC)) WHERE n <= 9000 AND b <= 1000000000000""")
SQL["stream_trim"] = sql("job_events", "SELECT event_id, kind FROM job_events ORDER BY ts DESC, event_id DESC LIMIT 6000")
EDITS = """
place AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_time, created_no, utterance_id) - 1 AS p FROM stored),
e0 AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS kind, conv_id * 1000 + turn AS edit_no, 'u' || conv_id || '-' || (turn + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END) AS uid FROM conversations),
e1 AS (SELECT e0.*, CASE WHEN kind IN (0, 2) THEN 'update' WHEN kind IN (1, 3) THEN 'delete' ELSE 'add' END AS op, CASE WHEN kind IN (0, 1) THEN uid WHEN kind IN (2, 3) THEN pl.utterance_id END AS tid
 FROM e0 LEFT JOIN place pl ON pl.recording_id = e0.conv_id AND pl.p = e0.turn + 1),
ch AS (SELECT conv_id, tid, max(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) AS del, arg_max('text ' || turn, edit_no) FILTER (op = 'update') AS txt FROM e1 WHERE op <> 'add' AND tid IS NOT NULL GROUP BY conv_id, tid),
"""
SQL["apply_edits"] = sql("stored jobs", """
SELECT s.recording_id, s.utterance_id, CASE WHEN txt IS NULL THEN speaker_id ELSE 'EDITED' END AS speaker_id, coalesce(txt, text) AS text
FROM stored s LEFT JOIN ch ON ch.conv_id = s.recording_id AND ch.tid = s.utterance_id WHERE coalesce(del, 0) = 0
UNION ALL SELECT conv_id, 'a' || uid, 'EDITED', 'text ' || turn FROM e1 WHERE kind = 4 AND conv_id IN (SELECT job_id FROM jobs)""", EDITS)
SQL["apply_edits_not_found"] = sql("stored jobs", """
SELECT edit_no, op FROM e1 LEFT JOIN stored s ON s.recording_id = conv_id AND s.utterance_id = tid WHERE op <> 'add' AND s.utterance_id IS NULL
UNION ALL SELECT edit_no, op FROM e1 WHERE kind = 5 OR (kind = 4 AND conv_id NOT IN (SELECT job_id FROM jobs))""", EDITS)
SQL["retention_manifest"] = sql("jobs", """
SELECT job_id, storage_uri, 'audio' AS reason FROM jobs WHERE status IN ('COMPLETED', 'FAILED') AND created_at < TIMESTAMP '1997-12-31'
UNION ALL SELECT job_id, storage_uri, 'record' FROM jobs WHERE created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY""")
SQL["retention_records"] = sql("jobs", "SELECT job_id FROM jobs WHERE created_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
SQL["sweep"] = sql("jobs", """
SELECT job_id, action, CASE WHEN action = 'fail' THEN 'FAILED' ELSE 'PENDING' END AS new_status, CASE WHEN action = 'fail' THEN attempts + 1 ELSE attempts END AS new_attempts, action = 'fail' AS dead_letter,
 CASE WHEN action = 'fail' AND trim(coalesce(callback_url, '')) <> '' THEN '{"job_id":"' || job_id || '","file_name":"' || file_name || '","status":"FAILED","attempts":' || (attempts + 1) || ',"error_message":"Job processing timed out after 1800s (stale processing)"}' END AS payload
FROM (SELECT *, CASE WHEN status = 'PENDING' AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 300 SECOND THEN 'republish'
 WHEN status = 'PROCESSING' AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 1800 SECOND THEN CASE WHEN attempts < 3 THEN 'reset_republish' ELSE 'fail' END END AS action FROM jobs) WHERE action IS NOT NULL""")
SQL["sweep_again"] = sql("jobs", """
SELECT job_id, CASE WHEN late AND attempts >= 3 AND status = 'PROCESSING' THEN 'FAILED' WHEN late THEN 'PENDING' ELSE status END AS status,
 CAST(CASE WHEN late AND attempts >= 3 AND status = 'PROCESSING' THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
 CASE WHEN late THEN TIMESTAMP '1998-01-01' ELSE updated_at END AS updated_at, NULL::VARCHAR AS action
FROM (SELECT *, (status = 'PENDING' AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 300 SECOND)
 OR (status = 'PROCESSING' AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 1800 SECOND) AS late FROM jobs)""")
SQL["route_outcomes"] = sql("jobs", """
SELECT job_id, CASE status WHEN 'FAILED' THEN 'dead_letter' WHEN 'PENDING' THEN 'republish' ELSE 'ack' END AS route,
 CASE WHEN status = 'PENDING' THEN updated_at + to_seconds(CAST(least(30, power(2, greatest(0, attempts - 1))) AS INTEGER)) END AS not_before FROM jobs""")
SQL["reclaim_idle"] = sql("job_events", """
SELECT event_id, 'worker-1' AS consumer, CASE WHEN event_id % 5 >= 3 THEN 'fail_dead_letter' ELSE 'process' END AS action FROM job_events WHERE floor(value * 10000) >= 900000""")
SQL["delivery_step"] = sql("deliveries", """
SELECT delivery_id, CASE WHEN job_id % 19 = 0 THEN 'DEAD' WHEN outcome_code = 200 THEN 'SUCCESS' WHEN attempts + 1 >= 5 THEN 'DEAD' ELSE 'PENDING' END AS status, attempts + 1 AS attempts,
 CASE WHEN job_id % 19 <> 0 AND outcome_code <> 200 AND attempts + 1 < 5 THEN next_attempt_at + to_seconds(5 * (1 << attempts)) ELSE next_attempt_at END AS next_attempt_at,
 CASE WHEN job_id % 19 = 0 THEN 'SSRF Protection: Invalid or unsafe webhook URL ''' || url || '''' WHEN outcome_code <> 200 THEN 'HTTP 503: ' || left(repeat('busy ', CAST(job_id % 60 AS INTEGER)), 200) END AS error_message FROM deliveries""")
SQL["host_waves"] = sql("deliveries", """
SELECT delivery_id, host, (row_number() OVER (PARTITION BY host ORDER BY next_attempt_at, delivery_id) - 1) // 5 AS wave FROM (SELECT *, regexp_extract(url, '//([^/]+)', 1) AS host FROM deliveries)""")
SQL["webhook_payload"] = sql("jobs", """
SELECT job_id, '{"job_id":"' || job_id || '","file_name":"' || file_name || '","status":"FAILED","attempts":' || attempts || ',"error_message":"OSError: lost [FILE_PATH]"}' AS payload FROM jobs""")
SQL["webhook_payload_completed"] = sql("jobs stored segments recordings", """
SELECT job_id, '{"job_id":"' || job_id || '","file_name":"' || file_name || '","status":"COMPLETED","language":"tr","overlap_summary":' || coalesce(j, 'null') || ',"utterances":' || coalesce(u, '[]') || '}' AS payload
FROM jobs LEFT JOIN (SELECT recording_id, CAST(to_json({'supported': supported, 'total_overlap_seconds': total_overlap_seconds, 'overlap_percentage': overlap_percentage, 'interrupt_count': interrupt_count,
  'overlaps': coalesce(o, [])}) AS VARCHAR) AS j FROM summ LEFT JOIN listed USING (recording_id)) sm
 ON sm.recording_id = job_id LEFT JOIN (SELECT recording_id, CAST(to_json(list({'speaker_id': speaker_id, 'start_time': start_time, 'end_time': end_time, 'text': text} ORDER BY start_time, created_no, utterance_id)) AS VARCHAR) AS u
 FROM stored GROUP BY recording_id) st ON st.recording_id = job_id""", SUMMARY + f"""
listed AS (SELECT recording_id, list({{'speakers': [s1, s2], 'start_time': {R2.format('lo')}, 'end_time': {R2.format('hi')}, 'duration': {R2.format('hi - lo')}}}
 ORDER BY i_start, i_seg, j_start, j_seg) AS o FROM pairs GROUP BY recording_id),
""")
_KEY = b"whsec-test".ljust(64, b"\0")
_PADS = {name: "".join(f"{b ^ pad:02x}" for b in _KEY) for name, pad in (("inner", 0x36), ("outer", 0x5C))}


def hmac(message: str) -> str:
    """Signature of a text under the key of the queries."""
    return f"'sha256=' || sha256(unhex('{_PADS['outer']}') || unhex(sha256(unhex('{_PADS['inner']}') || encode({message}))))"


SQL["hmac_sign"] = sql("deliveries", f"""SELECT delivery_id, {hmac("epoch(next_attempt_at)::BIGINT || '.' || '{\"job_id\":\"' || job_id || '\"}'")} AS signature FROM deliveries""")
SQL["hmac_verify"] = sql("deliveries", f"""
SELECT delivery_id, coalesce(abs(2300 - try_cast(ts AS BIGINT)) <= 300, false) AND given = {hmac("ts || '.b' || delivery_id")} AS valid
FROM (SELECT *, {hmac("ts || '.b' || delivery_id")} || CASE WHEN delivery_id % 3 = 0 THEN '0' ELSE '' END AS given
 FROM (SELECT delivery_id, CASE WHEN delivery_id % 7 = 0 THEN 'soon' WHEN delivery_id % 5 = 0 THEN '1000' ELSE '2000' END AS ts FROM deliveries))""")
SQL["backoff"] = sql("deliveries", "SELECT delivery_id, CAST(5 * power(2, attempts) AS BIGINT) AS webhook_seconds, least(30.0, power(2, greatest(0, attempts - 1)))::DOUBLE AS worker_seconds FROM deliveries")
SQL["client_key"] = sql("job_events", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'key_hash:' || left(sha256('key-' || event_id), 16) WHEN event_id % 2 = 0 THEN 'ip:10.0.0.' || (event_id % 200) ELSE 'ip:127.0.0.1' END AS client FROM job_events""")
SQL["rate_limit"] = sql("job_events", """
SELECT event_id, client, period, request_no, CASE WHEN request_no > 5 THEN 429 ELSE 202 END AS code, CASE WHEN request_no > 5 THEN 60 END AS retry_after FROM (
SELECT event_id, job_id % 5 AS client, epoch_us(ts) // 3600000000 AS period, row_number() OVER (PARTITION BY job_id % 5, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS request_no FROM job_events)""")

# --- metrics ---
SQL["status_counts"] = sql("jobs deliveries", "SELECT 'jobs' AS tbl, status, count(*) AS n FROM jobs GROUP BY status UNION ALL SELECT 'deliveries', status, count(*) FROM deliveries GROUP BY status")
HISTOGRAM = """
SELECT stage, le, count(*) FILTER (seconds <= b) AS cumulative, round(sum(seconds), 4) AS total, count(*) AS n
FROM stages, (VALUES ('0.01', 0.01), ('0.05', 0.05), ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1), ('2.5', 2.5), ('5.0', 5), ('10.0', 10), ('30.0', 30), ('60.0', 60), ('120.0', 120), ('+Inf', 'infinity'::DOUBLE)) v(le, b) GROUP BY stage, le"""
SQL["stage_histogram"] = sql("stages", HISTOGRAM)
SQL["queue_gauges"] = sql("job_events jobs", """
SELECT (SELECT count(*) + count(*) FILTER (value > 50) FROM job_events)::BIGINT AS queue_depth, (SELECT count(*) FROM jobs WHERE status = 'PENDING' AND updated_at < TIMESTAMP '1998-01-01') AS pending_jobs,
 round(greatest(0, epoch(TIMESTAMP '2024-01-15') - (SELECT min(epoch_us(ts) // 1000) FROM job_events) / 1000.0), 3) AS oldest_age_seconds""")
RTF = """
runs AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, CASE WHEN user_id % 3 = 0 THEN 'feedback' ELSE 'full' END AS profile, value * 10 AS audio, value * 0.125 AS d, value * 0.25 AS v, value * 0.5 AS s, value * 0.875 AS t FROM events)
"""
SQL["rtf_k"] = sql("", """
SELECT model, profile, GROUPING(model, profile) AS level, round(sum(audio), 6) AS audio_seconds, round(sum(d), 6) AS decode_seconds, round(sum(v), 6) AS vad_seconds, round(sum(s), 6) AS stt_seconds,
 round(sum(t), 6) AS total_seconds, round(sum(t) / sum(audio), 6) AS rtf, round(sum(t * 4) / sum(audio), 6) AS k FROM runs GROUP BY ROLLUP (model, profile)""", RTF)
SQL["capacity_plan"] = sql("", """
SELECT model, profile, sec AS message_seconds, w AS workers, sec * 4000 AS total_audio, round(sec * 4000 * k / 3600, 6) AS cores_needed, round(sec * 4000 * rtf / w / 3600, 6) AS hours, w * 1.5::DOUBLE AS ram_gb
FROM (SELECT model, profile, sum(t) / sum(audio) AS rtf, sum(t * 4) / sum(audio) AS k FROM runs GROUP BY model, profile), (VALUES (10), (30), (60)) a(sec), (VALUES (1), (2), (4)) b(w)""", RTF)
SQL["operate"] = sql("jobs deliveries stored stages segments recordings job_events", """
SELECT 'repair' AS what, CASE WHEN status = 'PENDING' THEN 'republish' WHEN attempts < 3 THEN 'reset_republish' ELSE 'fail' END AS item, count(*) AS n FROM jobs
 WHERE (status = 'PENDING' AND updated_at < TIMESTAMP '1997-12-31 23:55:00') OR (status = 'PROCESSING' AND updated_at < TIMESTAMP '1997-12-31 23:30:00') GROUP BY ALL
UNION ALL SELECT 'manifest', 'audio', count(*) FROM jobs WHERE status IN ('COMPLETED', 'FAILED') AND created_at < TIMESTAMP '1997-12-31'
UNION ALL SELECT 'manifest', 'record', count(*) FROM jobs WHERE created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY
UNION ALL SELECT 'delivery', CASE WHEN outcome_code = 200 THEN 'SUCCESS' WHEN attempts + 1 >= 5 THEN 'DEAD' ELSE 'PENDING' END, count(*) FROM deliveries WHERE status = 'PENDING' AND next_attempt_at <= TIMESTAMP '1998-01-01' GROUP BY ALL
UNION ALL SELECT 'jobs', status, count(*) FROM jobs GROUP BY status UNION ALL SELECT 'deliveries', status, count(*) FROM deliveries GROUP BY status
UNION ALL SELECT 'kept', 'jobs', count(*) FROM jobs WHERE job_id NOT IN (SELECT job_id FROM old) HAVING count(*) > 0
UNION ALL SELECT 'kept', 'utterances', count(*) FROM stored WHERE recording_id NOT IN (SELECT job_id FROM old) HAVING count(*) > 0
UNION ALL SELECT 'kept', 'deliveries', count(*) FROM deliveries WHERE job_id NOT IN (SELECT job_id FROM old) HAVING count(*) > 0
UNION ALL SELECT 'stage', stage || ' ' || le, cumulative FROM (""" + HISTOGRAM + """)
UNION ALL SELECT 'fallback', from_engine || ' ' || to_engine || ' ' || reason, count(*) FROM skips GROUP BY ALL
UNION ALL SELECT 'gauge', g, v FROM (SELECT (SELECT count(*) + count(*) FILTER (value > 50) FROM job_events)::BIGINT AS queue_depth,
 (SELECT count(*) FROM jobs WHERE status = 'PENDING' AND updated_at < TIMESTAMP '1998-01-01') AS pending_jobs,
 CAST(floor(greatest(0, epoch(TIMESTAMP '2024-01-15') - (SELECT min(epoch_us(ts) // 1000) FROM job_events) / 1000.0)) AS BIGINT) AS oldest_age_seconds) UNPIVOT (v FOR g IN (queue_depth, pending_jobs, oldest_age_seconds))""",
"old AS (SELECT job_id FROM jobs WHERE created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY),\n" + ENGINES)
SQL["jobs_table"] = sql("jobs", """
SELECT job_id, external_id, storage_uri, file_name, status, callback_url, attempts, num_speakers, NULL::VARCHAR AS language, created_at FROM jobs WHERE status = 'PENDING'""")

# --- signal ---
SQL["downmix"] = sql("samples", "SELECT recording_id, pos, round((value + value / 2 + 0.01) / 2, 8) AS value FROM samples")


def frames(n: int) -> str:
    return f"frames AS (SELECT recording_id, pos // {n} AS frame, sum(value * value) / {n} AS energy FROM samples GROUP BY ALL HAVING count(*) = {n}),"


SQL["frame_energy"] = sql("samples", "SELECT recording_id, frame, round(energy, 8) AS energy, round(sqrt(energy), 8) AS rms, sqrt(energy) >= 0.5 AS loud FROM frames", frames(512))
SQL["sliding_energy"] = sql("samples", """
SELECT recording_id, w AS win_idx, round(sqrt(sum(value * value) / 120), 8) AS energy FROM (
 SELECT recording_id, value, unnest(range(greatest(0, (pos - 90) // 30), pos // 30 + 1)) AS w, pos FROM samples) WHERE pos >= w * 30 AND pos < w * 30 + 120 GROUP BY ALL HAVING count(*) = 120""")
SNR = frames(20) + """
ranked AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY energy) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM frames),
snr AS (SELECT recording_id, CASE WHEN noise <= 1e-10 THEN 40.0 ELSE 10 * log10(greatest(sig / noise, 1e-5)) END AS snr FROM (
 SELECT recording_id, avg(energy) FILTER (k > n - greatest(1, floor(0.3 * n))) AS sig, avg(energy) FILTER (k <= greatest(1, floor(0.2 * n))) AS noise FROM ranked GROUP BY recording_id)),
"""
SQL["snr_db"] = sql("samples", "SELECT recording_id, round(snr, 5) AS snr_db FROM snr", SNR)
SQL["denoise_gate"] = sql("samples", "SELECT recording_id, snr < 38 AS denoise FROM snr", SNR)
SQL["energy_threshold"] = sql("window_labels", """
SELECT recording_id, round(greatest(1e-4, quantile_cont(energy, 0.3) * 1.5), 8) AS speech, round(greatest(1e-5, quantile_cont(energy, 0.05)), 8) AS skip, round(quantile_cont(energy, 0.2), 8) AS hold FROM window_labels GROUP BY recording_id""")


def vad(n: int, samples: str = "samples") -> str:
    return f"""
vf AS (SELECT recording_id, pos // {n} AS frame, sqrt(sum(value * value) / {n}) AS rms FROM {samples} GROUP BY ALL HAVING count(*) = {n}),
fact AS (SELECT recording_id, greatest(1e-4, quantile_cont(rms, 0.3) * 1.5) AS lim, count(*) AS fn FROM vf GROUP BY recording_id),
len AS (SELECT recording_id, count(*) / max(sample_rate)::DOUBLE AS dur FROM {samples} GROUP BY recording_id),
sp AS (SELECT vf.*, fn FROM vf JOIN fact USING (recording_id) WHERE rms > lim),
sp2 AS (SELECT *, CASE WHEN frame - lag(frame) OVER r > 13 OR lag(frame) OVER r IS NULL THEN 1 ELSE 0 END AS f FROM sp WINDOW r AS (PARTITION BY recording_id ORDER BY frame)),
sp3 AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY frame) AS g FROM sp2),
ch AS (SELECT recording_id, min(frame) AS a, max(frame) AS b, max(fn) AS fn FROM sp3 GROUP BY recording_id, g),
vad0 AS (SELECT recording_id, {R2.format('a * 30 / 1000.0')} AS start_time, CASE WHEN fn - 1 - b < 13 THEN {R2.format('dur')} ELSE {R2.format('b * 30 / 1000.0')} END AS end_time, fn - 1 - b < 13 AS o FROM ch JOIN len USING (recording_id)),
vad1 AS (SELECT recording_id, start_time, end_time FROM vad0 WHERE o OR end_time > start_time),
vad AS (SELECT * FROM vad1 UNION ALL SELECT recording_id, 0.0, {R2.format('dur')} FROM len WHERE recording_id NOT IN (SELECT recording_id FROM vad1)),
"""


def resampled(rate: int) -> str:
    return f"""
out AS (SELECT recording_id, i, i * (1000 / {rate}.0::DOUBLE) AS q, n FROM (SELECT recording_id, n, unnest(range(CAST(floor(n / (1000 / {rate}.0::DOUBLE)) AS BIGINT))) AS i FROM (SELECT recording_id, count(*) AS n FROM samples GROUP BY recording_id))),
res AS (SELECT o.recording_id, i AS pos, CASE WHEN b.value IS NULL THEN a.value ELSE a.value * (1 - (q - floor(q))) + b.value * (q - floor(q)) END AS value, {rate} AS sample_rate
 FROM out o JOIN samples a ON a.recording_id = o.recording_id AND a.pos = CAST(floor(q) AS BIGINT) LEFT JOIN samples b ON b.recording_id = o.recording_id AND b.pos = CAST(floor(q) AS BIGINT) + 1),
"""


SQL["energy_vad"] = sql("samples", "SELECT * FROM vad", vad(30))
SQL["linear_resample"] = sql("samples", "SELECT recording_id, pos, round(value, 8) AS value FROM res", resampled(1600))
SQL["signal_job"] = sql("samples", "SELECT * FROM vad", resampled(500) + vad(15, "res"))
SQL["signal_job_noise"] = sql("samples", "SELECT recording_id, round(snr, 5) AS snr_db, snr < 38 AS denoise FROM len LEFT JOIN snr USING (recording_id)", resampled(500) + """
len AS (SELECT DISTINCT recording_id FROM res),
frames AS (SELECT recording_id, pos // 10 AS frame, sum(value * value) / 10 AS energy FROM res GROUP BY ALL HAVING count(*) = 10),
""" + SNR.partition("),\n")[2])

# --- diarisation ---
SQL["pairwise_cosine"] = sql("window_embeddings", """
SELECT recording_id, win_idx, round(list_cosine_similarity(embedding, p), 6) AS similarity FROM (SELECT *, lag(embedding) OVER (PARTITION BY recording_id ORDER BY win_idx) AS p FROM window_embeddings) WHERE p IS NOT NULL""")
SQL["similar_windows"] = sql("window_embeddings", """
SELECT recording_id, win_idx, CAST(rank AS INTEGER) AS rank, other_idx, round(similarity, 6) AS similarity FROM (
 SELECT *, row_number() OVER (PARTITION BY recording_id, win_idx ORDER BY similarity DESC, other_idx) AS rank FROM (
  SELECT a.recording_id, a.win_idx, b.win_idx AS other_idx, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
  FROM window_embeddings a JOIN window_embeddings b ON a.recording_id = b.recording_id AND a.win_idx <> b.win_idx)) WHERE rank <= 5""")
SQL["standardise"] = sql("window_embeddings", """
SELECT recording_id, win_idx, f, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 5) + 0.0 AS v FROM (
 SELECT recording_id, win_idx, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS f, unnest(embedding) AS v FROM window_embeddings) WINDOW w AS (PARTITION BY recording_id, f)""")
FILLED = """
ff AS (SELECT *, last_value(raw_label IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY win_idx) AS l, arg_min(raw_label, win_idx) OVER (PARTITION BY recording_id) AS f0 FROM window_labels),
filled AS (SELECT recording_id, win_idx, coalesce(l, f0, 0) AS label, energy, count(*) OVER (PARTITION BY recording_id) AS n FROM ff),
"""
SQL["label_ffill"] = sql("window_labels", "SELECT recording_id, win_idx, label FROM filled", FILLED)
VOTE = """CASE WHEN {n} < 3 OR win_idx = 0 OR win_idx = {n} - 1 THEN {l} WHEN lag({l}) OVER r = lead({l}) OVER r THEN lag({l}) OVER r
 WHEN {l} IN (lag({l}) OVER r, lead({l}) OVER r) THEN {l} ELSE least(lag({l}) OVER r, {l}, lead({l}) OVER r) END"""
R = "WINDOW r AS (PARTITION BY recording_id ORDER BY win_idx)"
SQL["majority_vote"] = sql("window_labels", f"SELECT recording_id, win_idx, {VOTE.format(n='n', l='label')} AS label FROM filled {R}", FILLED)
SQL["median_labels"] = sql("window_labels", """
SELECT recording_id, win_idx, list_sort(list_concat(fr, list_resize([]::BIGINT[], w - len(fr), 0)))[w // 2 + 1] AS label FROM (
 SELECT recording_id, win_idx, w, CASE w WHEN 7 THEN list(label) OVER (p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) WHEN 5 THEN list(label) OVER (p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
  WHEN 3 THEN list(label) OVER (p ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE [label] END AS fr
 FROM (SELECT *, CASE WHEN least(7, n) % 2 = 0 THEN greatest(1, least(7, n) - 1) ELSE least(7, n) END AS w FROM filled) WINDOW p AS (PARTITION BY recording_id ORDER BY win_idx))""", FILLED)
SQL["smooth_labels"] = sql("window_labels", f"""
SELECT recording_id, win_idx, CASE WHEN n < 3 THEN v WHEN many THEN {VOTE.format(n='n', l='v')} ELSE list_sort([coalesce(lag(v) OVER r, 0), v, coalesce(lead(v) OVER r, 0)])[2] END AS label FROM (
 SELECT *, (SELECT count(DISTINCT v) > 2 FROM vv x WHERE x.recording_id = vv.recording_id) AS many FROM vv) {R}""",
 FILLED + "vv AS (SELECT recording_id, win_idx, n, CASE WHEN recording_id % 2 = 0 THEN label % 2 ELSE label END AS v FROM filled),")
SQL["gated_transition"] = sql("window_labels", """
SELECT recording_id, win_idx, last_value(c IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY win_idx) AS label FROM (
 SELECT recording_id, win_idx, CASE WHEN win_idx = 0 OR energy < h OR (min(label) OVER f = max(label) OVER f AND min(energy) OVER f < h) THEN label END AS c
 FROM (SELECT *, quantile_cont(energy, 0.2) OVER (PARTITION BY recording_id) AS h FROM filled) WINDOW f AS (PARTITION BY recording_id ORDER BY win_idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))""", FILLED)
SQL["labels_to_segments"] = sql("window_labels", """
SELECT recording_id, k - 1 AS seg_no, 'SPEAKER_' || lpad(label::VARCHAR, 2, '0') AS speaker_id, CASE WHEN k = 1 THEN 0.0 ELSE round(win_idx * 0.3::DOUBLE + 0.6, 6) END::DOUBLE AS start_time, round(coalesce(nx * 0.3::DOUBLE + 0.6, n * 0.3::DOUBLE + 1.2), 6)::DOUBLE AS end_time FROM (
 SELECT *, row_number() OVER r AS k, lead(win_idx) OVER r AS nx FROM (SELECT * FROM (SELECT *, lag(label) OVER r AS pl FROM filled """ + R + """) WHERE pl IS NULL OR pl <> label) """ + R + ")", FILLED)

# --- containers ---
SQL["audio_sniff"] = """
SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN 'WAV' ELSE (CASE (event_id // 4) % 7 WHEN 0 THEN 'MP3' WHEN 1 THEN 'FLAC' WHEN 2 THEN 'OGG' WHEN 3 THEN 'M4A' END) END AS container FROM events"""
SQL["wav_metadata"] = """
SELECT event_id, CASE WHEN w THEN event_id % 2 + 1 ELSE 1 END::INTEGER AS channels, CASE WHEN w THEN 8000 + event_id % 7 * 1000 ELSE 16000 END::INTEGER AS sample_rate,
 CASE WHEN w THEN (event_id % 5000) * 4 // ((event_id % 2 + 1) * 2) END AS frames,
 CASE WHEN w THEN round(((event_id % 5000) * 4 // ((event_id % 2 + 1) * 2)) / (8000 + event_id % 7 * 1000)::DOUBLE, 6) ELSE 0.0 END AS duration_sec,
 CASE WHEN w THEN 'WAV' ELSE 'MP3' END AS format, CASE WHEN NOT w THEN (CASE (event_id // 4) % 7 WHEN 5 THEN 4 WHEN 6 THEN 2 ELSE 14 END) END::BIGINT AS file_size_bytes FROM (SELECT *, event_id % 4 <> 3 AS w FROM events)"""

# --- job history and streams ---
STATES = sql("job_events", """
SELECT job_id, status, attempts, token_us, updated_us FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS last FROM st) WHERE last = 1 AND status IS NOT NULL""",
"""ev AS (SELECT job_id, kind, epoch_us(ts) AS us, value > 150 AS perm, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM job_events),
st AS (WITH RECURSIVE s AS (
 SELECT DISTINCT job_id, 0::BIGINT AS k, NULL::VARCHAR AS status, 0 AS attempts, NULL::BIGINT AS token_us, NULL::BIGINT AS updated_us FROM ev
 UNION ALL
 SELECT s.job_id, e.k,
  CASE WHEN kind = 'submit' AND status IS NULL THEN 'PENDING' WHEN kind = 'claim' AND (status = 'PENDING' OR (status = 'PROCESSING' AND us - updated_us > 36000000000)) THEN 'PROCESSING'
   WHEN status = 'PROCESSING' AND kind = 'complete' THEN 'COMPLETED' WHEN status = 'PROCESSING' AND kind = 'fail' THEN CASE WHEN perm OR attempts + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END ELSE status END,
  CASE WHEN status = 'PROCESSING' AND kind = 'fail' THEN attempts + 1 ELSE attempts END,
  CASE WHEN kind = 'claim' AND (status = 'PENDING' OR (status = 'PROCESSING' AND us - updated_us > 36000000000)) THEN us ELSE token_us END,
  CASE WHEN (kind = 'submit' AND status IS NULL) OR (kind = 'claim' AND (status = 'PENDING' OR (status = 'PROCESSING' AND us - updated_us > 36000000000)))
   OR (status = 'PROCESSING' AND kind IN ('heartbeat', 'complete', 'fail')) THEN us ELSE updated_us END
 FROM s JOIN ev e ON e.job_id = s.job_id AND e.k = s.k + 1) SELECT * FROM s)""")
SQL["job_states"] = STATES
SQL["stream_job_states"] = STATES
SQL["stream_job_states_late"] = f"""
SELECT concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS job_id, status, attempts, token_us, updated_us FROM (SELECT *, md5(job_id::VARCHAR) AS h FROM ({STATES}))"""
SQL["stream_rate_limit"] = sql("job_events", """
SELECT job_id % 5 AS client, epoch_us(ts) // 3600000000 AS period, count(*) AS requests, greatest(0, count(*) - 5) AS rejected FROM job_events GROUP BY ALL""")
SQL["stream_dedupe"] = sql("job_events", """
SELECT external_id, CASE WHEN external_id IS NULL THEN count(*) ELSE 1 END AS n FROM (SELECT CASE WHEN event_id % 4 <> 0 THEN 'ext-' || job_id END AS external_id FROM job_events) GROUP BY external_id""")
SQL["stream_first_arrival"] = sql("job_events", """
SELECT external_id, event_id AS job_id, epoch_us(ts) AS ts_us FROM (
 SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY ts, event_id) AS k FROM (SELECT event_id, ts, 'ext-' || job_id AS external_id FROM job_events WHERE event_id % 4 <> 0 AND job_id IS NOT NULL)) WHERE k = 1""")
SQL["stream_jobs_once"] = sql("job_events", "SELECT DISTINCT 'job-' || job_id AS job_id, 1::BIGINT AS n FROM job_events WHERE job_id IS NOT NULL")
SQL["stream_status_counts"] = sql("job_events", "SELECT kind AS status, count(*) AS n FROM job_events GROUP BY kind")
SQL["stream_stage_histogram"] = sql("job_events", """
SELECT kind AS stage, b.i AS bucket, count(*) FILTER (value / 10 <= b.le) AS cumulative, count(*) AS n
FROM job_events, (VALUES (0, 0.01), (1, 0.05), (2, 0.1), (3, 0.5), (4, 1), (5, 2.5), (6, 5), (7, 10), (8, 30), (9, 60), (10, 120), (11, 'infinity'::DOUBLE)) b(i, le) GROUP BY kind, b.i""")
SQL["stream_delivery_results"] = """
SELECT event_id AS delivery_id, CASE WHEN event_id % 10 = 0 THEN 'DEAD' WHEN event_id % 3 = 0 THEN 'SUCCESS' WHEN event_id % 6 + 1 >= 5 THEN 'DEAD' ELSE 'PENDING' END AS status, CAST(event_id % 6 + 1 AS INTEGER) AS attempts,
 CASE WHEN event_id % 10 <> 0 AND event_id % 3 <> 0 AND event_id % 6 + 1 < 5 THEN ts + to_seconds(CAST(5 * power(2, event_id % 6) AS INTEGER)) ELSE ts END AS next_attempt_at FROM events"""
SQL["delivery_attempts"] = SQL["stream_delivery_attempts"] = sql("job_events", """
SELECT event_id AS delivery_id, CASE WHEN ok THEN 'SUCCESS' WHEN tries >= 5 THEN 'DEAD' ELSE 'PENDING' END AS status, tries AS attempts,
 CASE WHEN NOT ok AND tries < 5 THEN ts + to_seconds(CAST(5 * power(2, tries - 1) AS INTEGER)) ELSE ts END AS next_attempt_at,
 CASE WHEN NOT heard THEN 'timeout' WHEN NOT ok THEN 'HTTP 503: busy' END AS error_message
FROM (SELECT *, heard AND event_id % 3 = 0 AS ok, CAST(event_id % 6 + 1 AS INTEGER) AS tries FROM (SELECT *, event_id % 7 <> 0 AND event_id % 11 <> 0 AS heard FROM job_events))""")
SQL["stream_route_outcomes"] = sql("job_events", """
SELECT event_id, CASE kind WHEN 'fail' THEN 'dead_letter' WHEN 'claim' THEN 'republish' ELSE 'ack' END AS route,
 CASE WHEN kind = 'claim' THEN TIMESTAMP '2024-01-15' + to_seconds(CAST(least(30, power(2, greatest(0, event_id % 7 - 1))) AS INTEGER)) END AS not_before FROM job_events""")
SQL["stream_jobs"] = """
SELECT event_id AS job_id, CASE WHEN event_id % 2 = 0 THEN 'a.wav' END AS file_name, CASE WHEN event_id % 4 = 1 THEN 'single' ELSE 'diarise' END AS gate FROM events"""

# --- clustering: the closest pair each time, ties to smaller numbers ---
SQL["cluster_average_linkage"] = """
WITH RECURSIVE w AS (SELECT label::BIGINT AS r, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cid, embedding::DOUBLE[] AS x FROM embeddings),
unit AS (SELECT r, cid, list_transform(x, lambda v: v / CASE WHEN list_dot_product(x, x) > 0 THEN sqrt(list_dot_product(x, x)) ELSE 1 END) AS u FROM w),
s AS (
 SELECT r, 0 AS k, cid, 1.0::DOUBLE AS n, u AS s, NULL::DOUBLE AS h, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM unit
 UNION ALL
 SELECT s.r, s.k + 1, s.cid, s.n + coalesce(o.n, 0), CASE WHEN o.s IS NULL THEN s.s ELSE list_transform(list_zip(s.s, o.s), lambda p: p[1] + p[2]) END, m.h, m.a, m.b
 FROM s JOIN (SELECT x.r, min({'h': round(1 - list_dot_product(x.s, y.s) / (x.n * y.n), 9), 'a': x.cid, 'b': y.cid}) AS m FROM s x JOIN s y ON x.r = y.r AND x.cid < y.cid GROUP BY x.r) best ON best.r = s.r
 LEFT JOIN s o ON o.r = s.r AND o.cid = m.b AND s.cid = m.a
 WHERE s.cid <> m.b),
merges AS (SELECT DISTINCT r, h, lo, hi FROM s WHERE k > 0),
sizes AS (SELECT r, count(*) AS n, greatest(1, least(10, count(*) - coalesce((SELECT count(*) FROM merges WHERE merges.r = unit.r AND h < 0.55), 0))) AS want FROM unit GROUP BY r),
kept AS (SELECT r, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY h, hi DESC) AS k FROM merges) JOIN sizes USING (r) WHERE k <= n - want),
up AS (SELECT r, cid, cid AS top FROM unit UNION ALL SELECT up.r, up.cid, kept.lo FROM up JOIN kept ON kept.r = up.r AND kept.hi = up.top)
SELECT r AS recording_id, cid AS win_idx, dense_rank() OVER (PARTITION BY r ORDER BY top) - 1 AS label FROM (SELECT r, cid, min(top) AS top FROM up GROUP BY r, cid)"""
