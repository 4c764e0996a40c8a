"""DuckDB forms of the derived tables, as common table expressions."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tokens": (
        (),
        r"""SELECT conv_id AS recording_id, turn, role, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS i, unnest(w) AS word
FROM (SELECT conv_id, turn, role, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS w FROM conversations)""",
    ),
    "words": (
        ("tokens",),
        """SELECT recording_id, turn, role, i, pos, word, ms / 1e3 AS start_time, (ms + 300) / 1e3 AS end_time, ms FROM (
SELECT *, pos * 400 + turn * 500 + (pos // 23) * 2000 AS ms FROM (
SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY turn, i) - 1 AS pos FROM tokens))""",
    ),
    "segments": (
        ("words",),
        """SELECT recording_id, turn * 2 + 1 AS seg_no, concat('SPK_', role) AS speaker_id,
(min(ms) + (turn % 2) * 450) / 1e3 AS start_time, (max(ms) + 300 + (CASE WHEN turn % 3 = 2 THEN 700 ELSE 0 END)) / 1e3 AS end_time
FROM words GROUP BY recording_id, turn, role
UNION ALL
SELECT recording_id, turn * 2, 'SPK_noise', ms / 1e3, (ms + 300) / 1e3 FROM words WHERE turn % 2 = 0 AND i = 5""",
    ),
    "intervals": (
        ("words",),
        """SELECT recording_id, pos // 23 AS blk, min(ms) / 1e3 AS start_time, (max(ms) + 300) / 1e3 AS end_time
FROM words GROUP BY recording_id, pos // 23 HAVING (pos // 23) % 5 <> 4""",
    ),
    "recordings": (
        (),
        """SELECT conv_id AS recording_id, CASE WHEN conv_id % 4 = 0 THEN 0.0 ELSE count(*) * 20.0 + 0.5 END::DOUBLE AS duration_seconds,
CAST(conv_id % 3 + 1 AS INTEGER) AS num_speakers FROM conversations GROUP BY conv_id""",
    ),
    "utterances": (
        (),
        """SELECT recording_id, utt_no, CASE WHEN (utt_no // 2) % 2 = 0 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker_id,
(off + gap) / 1e3 AS start_time, (off + gap + length(text) * 60) / 1e3 AS end_time, text FROM (
SELECT *, utt_no * 400 + (utt_no // 3) * 3000 AS gap,
CAST(coalesce(sum(length(text)) OVER (PARTITION BY recording_id ORDER BY utt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 60 AS BIGINT) AS off
FROM (SELECT conv_id AS recording_id, turn AS utt_no,
concat(CASE WHEN conv_id % 3 = 0 AND turn < 2 THEN 'çağrı merkezi hoş geldiniz ' ELSE '' END, text,
CASE (conv_id + turn) % 5 WHEN 1 THEN ' şikayetinizi not aldım ve devam ediyoruz' WHEN 2 THEN ' neden gecikti ? Bilmiyorum?? tamam.'
WHEN 3 THEN ' evet evet evet evet, tamam,tamam, tamam , son' WHEN 4 THEN '.' ELSE '' END) AS text FROM conversations))""",
    ),
    "stored": (
        (),
        """SELECT conv_id AS recording_id, concat('u', conv_id, '-', turn) AS utterance_id, concat('SPK_', role) AS speaker_id,
(turn // 2) * 1500 / 1e3 AS start_time, (turn // 2) * 1500 / 1e3 + 1.25 AS end_time, turn % 2 AS created_no, text FROM conversations""",
    ),
    "jobs": (
        (),
        """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 <> 0 THEN concat('ext-', o_orderkey % 5000) END AS external_id,
concat('disk://', o_orderkey, '.wav') AS storage_uri,
concat('call_', o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP3' WHEN 2 THEN '.flac' WHEN 3 THEN '.m4a' WHEN 4 THEN '.ogg' WHEN 5 THEN '.exe' ELSE '' END) AS file_name,
CAST(floor(o_totalprice) AS BIGINT) * 1000 AS size_bytes, CAST(o_custkey % 13 AS INTEGER) AS num_speakers,
CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'PROCESSING' END AS status,
CAST(o_orderkey % 4 AS INTEGER) AS attempts, o_orderdate AS created_at, o_orderdate AS updated_at,
CASE WHEN o_orderkey % 3 = 0 THEN concat('https://h', o_custkey % 20, '.example.com/cb') END AS callback_url FROM orders""",
    ),
    "job_events": (
        (),
        """SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind, value FROM events""",
    ),
    "stages": (
        (),
        """SELECT CASE event_type WHEN 'signup' THEN 'normalize' WHEN 'view' THEN 'vad' WHEN 'click' THEN 'stt' WHEN 'purchase' THEN 'diarization' ELSE 'fusion' END AS stage, value / 10.0 AS seconds FROM events""",
    ),
    "deliveries": (
        (),
        """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS delivery_id,
l_orderkey AS job_id, concat('https://h', l_suppkey % 20, '.example.com/cb') AS url, CAST((l_orderkey + l_linenumber) % 6 AS INTEGER) AS attempts,
l_shipdate AS next_attempt_at, CASE WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'SUCCESS' END AS status,
CASE WHEN l_returnflag = 'N' THEN 200 ELSE 503 END AS outcome_code FROM lineitem""",
    ),
    "window_embeddings": (
        (),
        """SELECT label::BIGINT AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS win_idx, vec_id, embedding::DOUBLE[] AS embedding FROM embeddings""",
    ),
    "window_labels": (
        (),
        """SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS win_idx,
CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value / 10) AS BIGINT) % 3 END AS raw_label, value / 1e2 AS energy FROM events""",
    ),
    "samples": (
        (),
        """SELECT rec AS recording_id, pos, 1000 AS sample_rate, (CASE WHEN (pos // 500) % 3 = 1 THEN 1 ELSE 100 END) * ((event_id * 37 + rec * 11) % 201 - 100) / 1e4 AS value
FROM (SELECT event_id, event_id // 2000 AS rec, event_id % 2000 AS pos FROM events)""",
    ),
}


def sql(views: str, body: str, extra: str = "") -> str:
    """A query over derived tables: ``views`` names them, ``extra`` adds its own CTEs."""
    need: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in need:
            need.append(name)

    for v in views.split():
        visit(v)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in need]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()
