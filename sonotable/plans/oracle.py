"""DuckDB SQL for every registered query, over the driver's pre-registered views.

Fixture views are CTEs written from FIXTURES.md independently of the Spark code;
each query's SQL states the operator's semantics directly (windows, theta joins,
plain GROUP BY), which is what the Spark plans are checked against.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (sql, deps)


cte("fx_ev", [], """
SELECT event_id, ts, user_id, event_type,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
       'f' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS file_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS segment_idx
FROM events""")

cte("fx_segments", ["fx_ev"], """
SELECT file_id,
       CAST(segment_idx AS BIGINT) AS segment_idx,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'SPEAKER_0' || CAST(event_id % 3 AS VARCHAR) END AS speaker,
       CAST(segment_idx * 7000 + (event_id % 5) * 100 AS BIGINT) AS start_ms,
       CAST(segment_idx * 7000 + (event_id % 5) * 100 + k * 75 AS BIGINT) AS end_ms,
       CASE WHEN k * 75 < 500 THEN 'too_short'
            WHEN event_type = 'error' THEN 'error'
            WHEN event_type = 'view' THEN 'neutral'
            WHEN event_type = 'click' THEN 'happy'
            WHEN event_type = 'purchase' THEN 'surprise'
            WHEN event_type = 'signup' THEN 'sad' END AS emotion,
       CASE WHEN k * 75 < 500 OR event_type = 'error' THEN CAST(0 AS DOUBLE)
            ELSE CAST((event_id * 37 + k) % 1001 AS DOUBLE) / 1000 END AS emotion_confidence,
       CASE WHEN k * 75 < 500 THEN 'too_short'
            WHEN event_id % 41 = 0 THEN 'error'
            WHEN event_id % 43 = 0 THEN NULL
            ELSE ['en', 'hi', 'ta', 'unknown'][CAST((user_id + event_id) % 4 AS INTEGER) + 1] END AS language,
       CASE WHEN k * 75 < 500 OR event_id % 41 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST((event_id * 53 + k) % 1001 AS DOUBLE) / 1000 END AS language_confidence,
       user_id
FROM fx_ev""")

cte("fx_stage_log", [], """
SELECT 'f' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS file_id,
       event_id AS seq,
       epoch_us(ts) AS us,
       CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed'
                       WHEN 'error' THEN 'failed' ELSE 'stage' END AS action,
       CASE WHEN event_type IN ('view', 'click')
            THEN ['download', 'diarize', 'emotion', 'language', 'annotate'][CAST(event_id % 5 AS INTEGER) + 1] END AS stage,
       CASE WHEN event_type = 'error'
            THEN ['CUDA Out of Memory', 'HTTP 401 for gated model', 'FFmpeg exited 1', 'Download failed'][CAST(event_id % 4 AS INTEGER) + 1] END AS error
FROM events""")

cte("fx_lines", [], """
SELECT page_id AS line_no,
       CASE page_id % 8
         WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(CAST(page_id AS VARCHAR)), 1, 11) || '&t=5'
         WHEN 1 THEN 'https://youtu.be/' || substr(md5(CAST(page_id AS VARCHAR)), 1, 11) || '?t=5'
         WHEN 2 THEN 'https://www.youtube.com/embed/' || substr(md5(CAST(page_id AS VARCHAR)), 1, 11)
         WHEN 3 THEN 'https://m.youtube.com/shorts/' || substr(md5(CAST(page_id AS VARCHAR)), 1, 11)
         WHEN 4 THEN '/data/in/clip ' || CAST(page_id AS VARCHAR) || '.tar.gz'
         WHEN 5 THEN '#' || url
         WHEN 6 THEN '   '
         ELSE url END AS line
FROM pages""")

# usable input lines with their ids, stated per line shape
cte("fx_inputs", ["fx_lines"], """
SELECT line_no, trim(line) AS source,
       regexp_matches(trim(line), '^https?://') AS is_url,
       CASE
         WHEN line_no % 8 IN (0, 1, 2, 3) THEN substr(md5(CAST(line_no AS VARCHAR)), 1, 11)
         WHEN line_no % 8 = 4 THEN 'clip ' || CAST(line_no AS VARCHAR) || '.tar'
         ELSE substr(regexp_replace(trim(line), '[^a-zA-Z0-9_-]', '_', 'g'), 1, 32)
       END AS file_id
FROM fx_lines
WHERE trim(line) <> '' AND NOT starts_with(line, '#')""")

cte("fx_landed", ["fx_inputs"], """
SELECT file_id, '/landing/' || file_id || '.webm' AS path FROM fx_inputs WHERE line_no % 3 <> 0
UNION ALL
SELECT file_id, '/landing/' || file_id || '.m4a' AS path FROM fx_inputs WHERE line_no % 3 <> 0 AND line_no % 9 = 1""")

cte("fx_scores", [], """
SELECT doc_id,
       CAST((doc_id * 13 + n_chars) % 101 AS BIGINT) AS w_en,
       CAST((doc_id * 29 + n_chars) % 101 AS BIGINT) AS w_fr,
       CAST((doc_id * 41 + n_chars) % 101 AS BIGINT) AS w_de,
       CAST((doc_id * 59 + n_chars) % 101 AS BIGINT) AS w_es
FROM documents""")


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]}\n)" for n in order]
    b = body.lstrip()
    if b[:4].upper() == "WITH":  # merge the body's own CTEs into one WITH list
        return "WITH " + ",\n".join(parts) + ",\n" + b[4:]
    return "WITH " + ",\n".join(parts) + "\n" + body


QUERIES: dict[str, str] = {}


def query(name: str, ctes: list[str], body: str) -> None:
    QUERIES[name] = with_ctes(ctes, body)


# --- summaries over fx_segments -------------------------------------------

query("file_summary", ["fx_segments"], """
SELECT file_id,
       CAST(count(DISTINCT speaker) + max(CASE WHEN speaker IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_speakers,
       CAST(count(*) AS BIGINT) AS num_segments,
       floor((max(end_ms) + 5) / 10) / 100 AS duration_sec,
       coalesce(string_agg(DISTINCT CASE WHEN language NOT IN ('too_short', 'error', 'unknown') THEN language END,
                           ',' ORDER BY CASE WHEN language NOT IN ('too_short', 'error', 'unknown') THEN language END),
                'unknown') AS languages_detected
FROM fx_segments GROUP BY file_id""")

_DOMINANT = """
SELECT file_id, {col} AS dominant_{col} FROM (
  SELECT file_id, {col},
         row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, min(segment_idx)) AS rn
  FROM fx_segments
  WHERE {col} IS NOT NULL AND {col} NOT IN ('too_short', 'error')
  GROUP BY file_id, {col}
) WHERE rn = 1"""

query("dominant_emotion", ["fx_segments"], _DOMINANT.format(col="emotion"))
query("dominant_language", ["fx_segments"], _DOMINANT.format(col="language"))

cte("fx_dominant", ["fx_segments"], """
SELECT file_id, value_kind, value FROM (
  SELECT file_id, value_kind, value,
         row_number() OVER (PARTITION BY file_id, value_kind ORDER BY count(*) DESC, min(segment_idx)) AS rn
  FROM (SELECT file_id, segment_idx, 'emotion' AS value_kind, emotion AS value FROM fx_segments
        UNION ALL
        SELECT file_id, segment_idx, 'language', language FROM fx_segments)
  WHERE value IS NOT NULL AND value NOT IN ('too_short', 'error')
  GROUP BY file_id, value_kind, value
) WHERE rn = 1""")

# m:ss or h:mm:ss of whole seconds s
_FMT = """CASE WHEN {s} >= 3600
  THEN CAST({s} // 3600 AS VARCHAR) || ':' || lpad(CAST(({s} % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')
  ELSE CAST({s} // 60 AS VARCHAR) || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') END"""


def fmt_ms(ms: str) -> str:
    s = f"CAST(floor(greatest({ms}, 0) / 1000) AS BIGINT)"
    return _FMT.format(s=s)


query("summary_metrics", ["fx_segments", "fx_dominant"], f"""
SELECT s.file_id,
       {fmt_ms('s.max_end_ms')} AS duration,
       s.num_speakers,
       coalesce(l.value, 'N/A') AS dominant_language,
       coalesce(e.value, 'N/A') AS dominant_emotion
FROM (SELECT file_id, max(end_ms) AS max_end_ms,
             CAST(count(DISTINCT speaker) + max(CASE WHEN speaker IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_speakers
      FROM fx_segments GROUP BY file_id) s
LEFT JOIN fx_dominant l ON l.file_id = s.file_id AND l.value_kind = 'language'
LEFT JOIN fx_dominant e ON e.file_id = s.file_id AND e.value_kind = 'emotion'""")

query("stage_outcomes", ["fx_segments"], """
SELECT file_id, 'emotion' AS stage,
       CAST(count(*) FILTER (WHERE emotion IS NULL OR emotion NOT IN ('too_short', 'error')) AS BIGINT) AS n_ok,
       CAST(count(*) FILTER (WHERE emotion = 'too_short') AS BIGINT) AS n_skipped,
       CAST(count(*) FILTER (WHERE emotion = 'error') AS BIGINT) AS n_errors
FROM fx_segments GROUP BY file_id
UNION ALL
SELECT file_id, 'language',
       CAST(count(*) FILTER (WHERE language IS NULL OR language NOT IN ('too_short', 'error')) AS BIGINT),
       CAST(count(*) FILTER (WHERE language = 'too_short') AS BIGINT),
       CAST(count(*) FILTER (WHERE language = 'error') AS BIGINT)
FROM fx_segments GROUP BY file_id""")

query("diarization_stats", ["fx_segments"], """
SELECT file_id, CAST(count(*) AS BIGINT) AS num_segments,
       CAST(count(DISTINCT speaker) + max(CASE WHEN speaker IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_speakers,
       count(*) = 0 AS no_speech
FROM fx_segments GROUP BY file_id""")

query("timeline_ticks", ["fx_segments"], """
WITH m AS (SELECT file_id, max(end_ms) AS mx, least(CAST(floor(max(end_ms) / 10000) AS BIGINT) + 1, 20) AS n
           FROM fx_segments GROUP BY file_id),
t AS (SELECT file_id, mx, n, CAST(i AS BIGINT) AS tick FROM m, range(0, n + 1) r(i)),
q AS (SELECT file_id, n, tick, tick * mx AS num, CAST(floor(tick * mx / (n * 1000)) AS BIGINT) AS qq FROM t)
SELECT file_id, tick, CAST(floor(num / n) AS BIGINT) AS tick_ms,
       CAST(CASE WHEN 2 * (num - qq * n * 1000) > n * 1000
                   OR (2 * (num - qq * n * 1000) = n * 1000 AND qq % 2 = 1) THEN qq + 1 ELSE qq END AS VARCHAR) || 's' AS label
FROM q""")

_PCT = "printf('%.1f%%', coalesce({c}, 0) * 100)"

query("segment_table", ["fx_segments"], f"""
SELECT file_id, segment_idx,
       {fmt_ms('start_ms')} AS start_text,
       {fmt_ms('end_ms')} AS end_text,
       coalesce(speaker, 'UNKNOWN') AS speaker,
       floor((end_ms - start_ms + 5) / 10) / 100 AS duration_s,
       coalesce(emotion, 'unknown') AS emotion,
       {_PCT.format(c='emotion_confidence')} AS confidence_pct,
       coalesce(language, 'unknown') AS language,
       {_PCT.format(c='language_confidence')} AS lang_confidence_pct
FROM fx_segments""")

query("timeline_rows", ["fx_segments"], f"""
SELECT file_id, segment_idx,
       coalesce(speaker, 'UNKNOWN') AS speaker,
       CAST(start_ms AS DOUBLE) / 1000 AS start,
       CAST(end_ms AS DOUBLE) / 1000 AS "end",
       CAST(end_ms - start_ms AS DOUBLE) / 1000 AS duration,
       coalesce(emotion, 'unknown') AS emotion,
       coalesce(language, '?') AS language,
       {_PCT.format(c='emotion_confidence')} AS emotion_conf,
       {_PCT.format(c='language_confidence')} AS lang_conf,
       CASE coalesce(emotion, 'unknown')
         WHEN 'neutral' THEN '#9E9E9E' WHEN 'happy' THEN '#4CAF50' WHEN 'angry' THEN '#F44336'
         WHEN 'sad' THEN '#2196F3' WHEN 'fear' THEN '#FF9800' WHEN 'surprise' THEN '#9C27B0'
         WHEN 'disgust' THEN '#795548' WHEN 'too_short' THEN '#BDBDBD' WHEN 'error' THEN '#E0E0E0'
         WHEN 'unknown' THEN '#BDBDBD' ELSE '#9E9E9E' END AS color
FROM fx_segments""")


# --- segment row operators -------------------------------------------------

query("normalised_segments", ["fx_segments"], """
SELECT file_id, segment_idx, coalesce(speaker, 'UNKNOWN') AS speaker,
       CAST(start_ms AS DOUBLE) / 1000 AS start, CAST(end_ms AS DOUBLE) / 1000 AS "end",
       coalesce(emotion, 'unknown') AS emotion, coalesce(emotion_confidence, 0) AS emotion_confidence,
       coalesce(language, 'unknown') AS language, coalesce(language_confidence, 0) AS language_confidence
FROM fx_segments""")

_REQUIRED = ["speaker", "start_ms", "end_ms", "emotion", "emotion_confidence", "language", "language_confidence"]
_VIOLATIONS = "\nUNION ALL\n".join(
    [f"SELECT 'missing_key' AS rule, file_id, segment_idx, '{c}' AS detail FROM fx_segments WHERE {c} IS NULL"
     for c in _REQUIRED]
    + ["SELECT 'end_not_after_start', file_id, segment_idx, CAST(NULL AS VARCHAR) FROM fx_segments WHERE end_ms <= start_ms",
       "SELECT 'unknown_emotion_label', file_id, segment_idx, emotion FROM fx_segments WHERE emotion NOT IN "
       "('neutral', 'happy', 'angry', 'sad', 'fear', 'surprise', 'disgust', 'too_short', 'error', 'unknown')"])
query("annotation_violations", ["fx_segments"], _VIOLATIONS)
query("quality_report", ["fx_segments"], f"""
SELECT rule, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT file_id) AS BIGINT) AS n_files
FROM ({_VIOLATIONS}) GROUP BY rule""")

query("gate_short", ["fx_segments"], """
SELECT file_id, segment_idx, end_ms - start_ms AS duration_ms,
       CASE WHEN end_ms - start_ms < 500 THEN 'too_short' ELSE 'model' END AS gate
FROM fx_segments""")

# --- inputs and ids ----------------------------------------------------------

query("clean_inputs", ["fx_inputs"], "SELECT line_no, source, is_url FROM fx_inputs")

query("file_ids", ["fx_inputs"], """
SELECT i.line_no, i.source, i.is_url, i.file_id, c.n > 1 AS collision
FROM fx_inputs i JOIN (SELECT file_id, count(DISTINCT source) AS n FROM fx_inputs GROUP BY file_id) c USING (file_id)""")

query("dedupe_inputs", ["fx_inputs"], """
SELECT file_id, line_no, source FROM (
  SELECT file_id, line_no, source, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn FROM fx_inputs
) WHERE rn = 1""")

query("upload_ids", ["fx_inputs"], """
SELECT line_no, source, 'clip_' || CAST(line_no AS VARCHAR) || '.tar' AS upload_id FROM fx_inputs WHERE NOT is_url""")

query("artifact_paths", ["fx_inputs"], """
SELECT file_id, 'out/audio/' || file_id || '.wav' AS wav_path,
       'out/annotations/' || file_id || '.json' AS json_path,
       'out/annotations/' || file_id || '.rttm' AS rttm_path
FROM (SELECT DISTINCT file_id FROM fx_inputs)""")

query("match_landed", ["fx_inputs", "fx_landed"], """
SELECT d.file_id, h.landed_path, CAST(coalesce(h.n, 0) AS BIGINT) AS n_candidates,
       CASE WHEN h.landed_path IS NULL THEN 'missing' ELSE 'landed' END AS status
FROM (SELECT DISTINCT file_id FROM fx_inputs) d
LEFT JOIN (SELECT file_id, min(path) AS landed_path, count(*) AS n FROM fx_landed
           WHERE NOT lower(path) LIKE '%.wav' GROUP BY file_id) h USING (file_id)""")

# --- state fold ----------------------------------------------------------------


def _fold_sql(src: str) -> str:
    return f"""
SELECT file_id,
       CASE WHEN arg_max(action, seq) FILTER (WHERE action IN ('started', 'completed', 'failed')) = 'started'
            THEN 'in_progress'
            ELSE arg_max(action, seq) FILTER (WHERE action IN ('started', 'completed', 'failed')) END AS status,
       arg_max(stage, seq) FILTER (WHERE action = 'stage') AS stage,
       CAST(NULL AS VARCHAR) AS url,
       arg_min(us, seq) FILTER (WHERE action = 'started') AS started_us,
       arg_max(us, seq) FILTER (WHERE action = 'completed') AS completed_us,
       CASE WHEN arg_max(action, seq) FILTER (WHERE action IN ('started', 'failed')) = 'failed'
            THEN arg_max(error, seq) FILTER (WHERE action = 'failed') END AS error
FROM (SELECT l.* FROM {src} l
      JOIN (SELECT file_id, min(seq) FILTER (WHERE action = 'started') AS first_seq FROM {src} GROUP BY file_id) f
      USING (file_id)
      WHERE f.first_seq IS NOT NULL AND l.seq >= f.first_seq)
GROUP BY file_id"""


cte("fx_log_before", ["fx_stage_log"], "SELECT * FROM fx_stage_log WHERE us < 1705363200000000")
cte("fx_state", ["fx_stage_log"], _fold_sql("fx_stage_log"))
cte("fx_state_before", ["fx_log_before"], _fold_sql("fx_log_before"))
cte("fx_files", ["fx_stage_log"], "SELECT DISTINCT file_id FROM fx_stage_log")

query("file_state", ["fx_state"], "SELECT * FROM fx_state")

query("status_counts", ["fx_state"], """
SELECT status, CAST(sum(n) AS BIGINT) AS n_files FROM (
  SELECT status, count(*) AS n FROM fx_state GROUP BY status
  UNION ALL SELECT 'completed', 0 UNION ALL SELECT 'failed', 0 UNION ALL SELECT 'in_progress', 0
) GROUP BY status""")

query("batch_result", ["fx_files", "fx_state", "fx_state_before"], """
SELECT CAST(count(*) FILTER (WHERE b.status = 'completed') AS BIGINT) AS skipped,
       CAST(count(*) FILTER (WHERE b.status IS DISTINCT FROM 'completed' AND a.status = 'completed') AS BIGINT) AS completed,
       CAST(count(*) FILTER (WHERE b.status IS DISTINCT FROM 'completed' AND a.status IS DISTINCT FROM 'completed') AS BIGINT) AS failed,
       count(*) FILTER (WHERE b.status IS DISTINCT FROM 'completed' AND a.status IS DISTINCT FROM 'completed') = 0 AS ok
FROM fx_files f LEFT JOIN fx_state_before b USING (file_id) LEFT JOIN fx_state a USING (file_id)""")

query("remaining_inputs", ["fx_files", "fx_state_before"], """
SELECT file_id FROM fx_files
WHERE file_id NOT IN (SELECT file_id FROM fx_state_before WHERE status = 'completed')""")

query("pending_stages", ["fx_files", "fx_state_before"], """
SELECT f.file_id, CAST(s.i AS BIGINT) AS stage_pos, s.stage
FROM fx_files f LEFT JOIN fx_state_before b USING (file_id)
CROSS JOIN (VALUES (0, 'download'), (1, 'diarize'), (2, 'emotion'), (3, 'language'), (4, 'annotate')) s(i, stage)
WHERE b.status IS NULL
   OR (b.status <> 'completed'
       AND (b.stage IS NULL OR s.i > CASE b.stage WHEN 'download' THEN 0 WHEN 'diarize' THEN 1 WHEN 'emotion' THEN 2
                                                  WHEN 'language' THEN 3 WHEN 'annotate' THEN 4 END))""")

query("stage_elapsed", ["fx_stage_log"], """
SELECT file_id, seq, action, stage, us - lag(us) OVER (PARTITION BY file_id ORDER BY seq) AS elapsed_us
FROM fx_stage_log""")

query("progress", ["fx_stage_log"], """
SELECT file_id, stage,
       CAST(CASE stage WHEN 'download' THEN 20 WHEN 'diarize' THEN 45 WHEN 'emotion' THEN 65
                       WHEN 'language' THEN 80 WHEN 'annotate' THEN 100 ELSE 0 END AS DOUBLE) / 100 AS progress,
       strftime(make_timestamp(us), '%H:%M:%S') AS clock
FROM (SELECT file_id, arg_max(stage, seq) AS stage, arg_max(us, seq) AS us
      FROM fx_stage_log WHERE action = 'stage' GROUP BY file_id)""")

query("error_triage", ["fx_stage_log"], """
SELECT file_id, seq, error,
       CASE WHEN contains(lower(error), 'out of memory') THEN 'memory'
            WHEN contains(lower(error), 'hf_token') OR contains(error, '401') THEN 'auth'
            WHEN contains(lower(error), 'ffmpeg') THEN 'tool'
            ELSE 'other' END AS category
FROM fx_stage_log WHERE action = 'failed'""")

# --- manifest --------------------------------------------------------------------

cte("fx_file_summary", ["fx_segments"], """
SELECT file_id,
       CAST(count(DISTINCT speaker) + max(CASE WHEN speaker IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_speakers,
       CAST(count(*) AS BIGINT) AS num_segments,
       floor((max(end_ms) + 5) / 10) / 100 AS duration_sec,
       coalesce(string_agg(DISTINCT CASE WHEN language NOT IN ('too_short', 'error', 'unknown') THEN language END,
                           ',' ORDER BY CASE WHEN language NOT IN ('too_short', 'error', 'unknown') THEN language END),
                'unknown') AS languages_detected
FROM fx_segments GROUP BY file_id""")

cte("fx_manifest", ["fx_stage_log", "fx_file_summary"], """
SELECT o.file_id, 'in/audio/' || o.file_id || '.wav' AS url, o.action AS status,
       CAST(CASE WHEN o.action = 'completed' THEN coalesce(s.num_speakers, 0) ELSE 0 END AS BIGINT) AS num_speakers,
       CAST(CASE WHEN o.action = 'completed' THEN coalesce(s.num_segments, 0) ELSE 0 END AS BIGINT) AS num_segments,
       CASE WHEN o.action = 'completed' THEN coalesce(s.duration_sec, 0) ELSE CAST(0 AS DOUBLE) END AS duration_sec,
       CASE WHEN o.action = 'completed' THEN coalesce(s.languages_detected, 'unknown') ELSE 'unknown' END AS languages_detected,
       o.us AS processed_us, o.seq AS append_seq
FROM fx_stage_log o
JOIN (SELECT file_id, min(seq) AS first_seq FROM fx_stage_log WHERE action = 'started' GROUP BY file_id) st USING (file_id)
LEFT JOIN fx_file_summary s USING (file_id)
WHERE o.action IN ('completed', 'failed') AND o.seq > st.first_seq""")

query("manifest", ["fx_manifest"], "SELECT * FROM fx_manifest")

query("latest_manifest", ["fx_manifest"], """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY processed_us DESC, append_seq DESC) AS rn FROM fx_manifest
) WHERE rn = 1""")


QUERIES["linked_turns"] = """
WITH t AS (
  SELECT 'f' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS file_id, event_id // 16 AS "window", event_id % 16 AS turn_idx, ascii(event_type) & 31 AS kind,
         event_id * 1000 AS start_ms, event_id * 1000 + (event_id % 11) * 200000 AS end_ms
  FROM events),
voices AS (SELECT file_id, kind, row_number() OVER (PARTITION BY file_id ORDER BY min("window" * 32 + kind)) - 1 AS n FROM t GROUP BY file_id, kind),
named AS (SELECT t.*, 'SPEAKER_' || lpad(CAST(n AS VARCHAR), 2, '0') AS speaker FROM t JOIN voices USING (file_id, kind)),
before AS (SELECT *, lag("window") OVER w AS prev_window, lag(end_ms) OVER w AS prev_end FROM named
           WINDOW w AS (PARTITION BY file_id, speaker ORDER BY "window", turn_idx)),
runs AS (SELECT *, sum(CASE WHEN prev_window < "window" AND start_ms < prev_end THEN 0 ELSE 1 END)
                  OVER (PARTITION BY file_id, speaker ORDER BY "window", turn_idx) AS run FROM before)
SELECT file_id, min("window") AS "window", arg_min(turn_idx, start_ms) AS turn_idx, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms
FROM runs GROUP BY file_id, speaker, run"""

QUERIES["manifest_upsert"] = QUERIES["latest_manifest"]


# --- interchange round trips ---------------------------------------------------

query("rttm_roundtrip", ["fx_segments"], """
SELECT file_id, segment_idx, coalesce(speaker, 'UNKNOWN') AS speaker,
       CAST(start_ms AS DOUBLE) / 1000 AS start, CAST(end_ms AS DOUBLE) / 1000 AS "end", true AS ok
FROM fx_segments""")

query("annotation_json_roundtrip", ["fx_segments"], """
SELECT file_id, segment_idx, coalesce(speaker, 'UNKNOWN') AS speaker,
       CAST(start_ms AS DOUBLE) / 1000 AS start, CAST(end_ms AS DOUBLE) / 1000 AS "end",
       coalesce(emotion, 'unknown') AS emotion, coalesce(emotion_confidence, 0) AS emotion_confidence,
       coalesce(language, 'unknown') AS language, coalesce(language_confidence, 0) AS language_confidence
FROM fx_segments""")

# --- model output top-1 (confidence compared as integer thousandths) -----------

_W = ["w_en", "w_fr", "w_de", "w_es"]
_BEST = """CASE WHEN w_en >= w_fr AND w_en >= w_de AND w_en >= w_es THEN 'en'
                WHEN w_fr >= w_de AND w_fr >= w_es THEN 'fr'
                WHEN w_de >= w_es THEN 'de' ELSE 'es' END"""
_TOP = "greatest(w_en, w_fr, w_de, w_es)"
_TOTAL = "(w_en + w_fr + w_de + w_es)"

query("top_label", ["fx_scores"], f"""
SELECT doc_id,
       CASE WHEN {_TOTAL} = 0 THEN 'error' ELSE {_BEST} END AS label,
       CAST(CASE WHEN {_TOTAL} = 0 THEN 0 ELSE floor((2000 * {_TOP} + {_TOTAL}) / (2 * {_TOTAL})) END AS BIGINT) AS score_milli
FROM fx_scores""")

query("argmax_language", ["fx_scores"], f"""
SELECT doc_id,
       CASE WHEN {_TOTAL} = 0 THEN 'error' ELSE {_BEST} END AS language,
       CAST(CASE WHEN {_TOTAL} = 0 THEN 0 ELSE floor((2000 * {_TOP} + {_TOTAL}) / (2 * {_TOTAL})) END AS BIGINT) AS confidence_milli
FROM fx_scores""")


# --- audio -------------------------------------------------------------------------

# theta join: every 10 ms sample t with start <= t < end, value by the fx_frames rule
query("segment_slices", ["fx_segments"], """
SELECT file_id, segment_idx, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(v * v) AS BIGINT) AS sum_sq
FROM (
  SELECT s.file_id, s.segment_idx,
         CAST(((j // 100) * 7919 + (j % 100) * (j % 100) * 31 + s.user_id * 17) % 2001 - 1000 AS BIGINT) AS v
  FROM fx_segments s, range(CAST(ceil(s.start_ms / 10) AS BIGINT), CAST(ceil(s.end_ms / 10) AS BIGINT)) r(j)
  WHERE s.end_ms - s.start_ms >= 500
) GROUP BY file_id, segment_idx""")

cte("fx_headers", ["fx_segments"], """
SELECT file_id,
       CAST([16000, 16000, 8000, 44100][CAST(user_id % 4 AS INTEGER) + 1] AS INTEGER) AS sample_rate,
       CAST(CASE WHEN user_id % 5 = 4 THEN 2 ELSE 1 END AS INTEGER) AS channels,
       CAST(floor(max_end_ms * [16000, 16000, 8000, 44100][CAST(user_id % 4 AS INTEGER) + 1] / 1000) AS BIGINT) AS n_frames
FROM (SELECT file_id, user_id, max(end_ms) AS max_end_ms FROM fx_segments GROUP BY file_id, user_id)""")

query("wav_headers", ["fx_headers"], "SELECT * FROM fx_headers")

query("validate_audio", ["fx_headers"], """
SELECT file_id, CAST(floor(n_frames * 1000 / sample_rate) AS BIGINT) AS duration_ms,
       (sample_rate = 16000 AND channels = 1 AND n_frames * 1000 >= sample_rate * 1000) AS valid,
       concat_ws(',', CASE WHEN sample_rate <> 16000 THEN 'sample_rate' END,
                      CASE WHEN channels <> 1 THEN 'channels' END,
                      CASE WHEN n_frames * 1000 < sample_rate * 1000 THEN 'too_short' END) AS problems,
       CASE WHEN n_frames * 1000 < sample_rate * 30000 THEN 'short_audio' ELSE '' END AS warnings
FROM fx_headers""")

query("normalise_pcm", ["fx_segments"], """
SELECT m.file_id, f AS clip_idx, CAST(0 AS BIGINT) AS frame_idx, CAST(100 AS BIGINT) AS n_samples,
       CAST((SELECT sum((f * 7919 + i * i * 31 + m.user_id * 17) % 2001 - 1000) FROM range(0, 100) r(i)) AS BIGINT) AS sample_sum
FROM (SELECT file_id, user_id, max(end_ms) AS mx FROM fx_segments GROUP BY file_id, user_id) m,
     range(0, CAST(floor(m.mx / 1000) AS BIGINT) + 1) fr(f)""")


# --- streaming forms: same results as their batch forms ----------------------------

QUERIES["stream_state"] = QUERIES["file_state"]
QUERIES["stream_progress"] = QUERIES["progress"]
QUERIES["stream_intake"] = QUERIES["dedupe_inputs"]

query("stream_intake_batches", ["fx_inputs"], """
SELECT file_id, line_no, source, line_no % 3 AS batch_id FROM (
  SELECT file_id, line_no, source, row_number() OVER (PARTITION BY file_id ORDER BY line_no % 3, line_no) AS rn FROM fx_inputs
) WHERE rn = 1""")

query("file_summary_audio", ["fx_file_summary", "fx_headers"], """
SELECT s.file_id, s.num_speakers, s.num_segments,
       CAST(floor((h.n_frames * 200 + h.sample_rate) / (2 * h.sample_rate)) AS DOUBLE) / 100 AS duration_sec,
       s.languages_detected
FROM fx_file_summary s JOIN fx_headers h USING (file_id)""")


query("segment_index_sliced", ["fx_ev"], "SELECT file_id, event_id, CAST(segment_idx AS BIGINT) AS segment_idx FROM fx_ev")

QUERIES["segment_index_ranged"] = QUERIES["segment_index_sliced"]
QUERIES["stage_elapsed_ranged"] = QUERIES["stage_elapsed"]

query("normalise_wav_files", ["fx_segments"], """
SELECT m.file_id, CAST(f AS BIGINT) AS frame_idx, CAST(100 AS BIGINT) AS n_samples,
       CAST((SELECT sum((f * 7919 + i * i * 31 + m.user_id * 17) % 2001 - 1000) FROM range(0, 100) r(i)) AS BIGINT) AS sample_sum
FROM (SELECT file_id, user_id, max(end_ms) AS mx FROM fx_segments GROUP BY file_id, user_id) m,
     range(0, CAST(floor(m.mx / 1000) AS BIGINT) + 1) fr(f)""")

QUERIES["wav_source"] = QUERIES["normalise_wav_files"]


# --- model operators with the deterministic stand-ins (exact integer statistics) ----

# samples of every segment of at least 500 ms, at the fixture's 100 Hz, up to a cap in ms
_SEG_SAMPLES = """
SELECT s.file_id, s.segment_idx, j - CAST(ceil(s.start_ms / 10) AS BIGINT) AS k,
       CAST(((j // 100) * 7919 + (j % 100) * (j % 100) * 31 + s.user_id * 17) % 2001 - 1000 AS BIGINT) AS v
FROM fx_segments s,
     range(CAST(ceil(s.start_ms / 10) AS BIGINT), CAST(ceil(least(s.end_ms, s.start_ms + {cap}) / 10) AS BIGINT)) r(j)
WHERE s.end_ms - s.start_ms >= 500"""

_EMOTION = f"""
WITH x AS ({_SEG_SAMPLES.format(cap=10**12)}),
a AS (SELECT file_id, segment_idx, sum(abs(v)) AS sa, count(*) AS n FROM x GROUP BY file_id, segment_idx)
SELECT s.file_id, s.segment_idx,
       CASE WHEN a.n IS NULL OR a.n < 50 THEN 'too_short'
            ELSE ['neutral', 'happy', 'angry', 'sad', 'fear', 'surprise', 'disgust'][
                 CAST(((a.sa * 10000) // (32768 * a.n)) % 7 AS INTEGER) + 1] END AS emotion,
       CASE WHEN a.n IS NULL OR a.n < 50 THEN CAST(0 AS DOUBLE) ELSE 0.9 END AS emotion_confidence
FROM fx_segments s LEFT JOIN a USING (file_id, segment_idx)"""
query("classify_emotion", ["fx_segments"], _EMOTION)

_LANGUAGE = f"""
WITH x AS ({_SEG_SAMPLES.format(cap=30000)}),
w AS (SELECT file_id, segment_idx,
             abs(sum(v) FILTER (WHERE k % 4 = 0)) + 32768 AS w0, abs(coalesce(sum(v) FILTER (WHERE k % 4 = 1), 0)) + 32768 AS w1,
             abs(coalesce(sum(v) FILTER (WHERE k % 4 = 2), 0)) + 32768 AS w2, abs(coalesce(sum(v) FILTER (WHERE k % 4 = 3), 0)) + 32768 AS w3,
             count(*) AS n
      FROM x GROUP BY file_id, segment_idx),
b AS (SELECT *, w0 + w1 + w2 + w3 AS tot, greatest(w0, w1, w2, w3) AS top,
             CASE WHEN w0 >= w1 AND w0 >= w2 AND w0 >= w3 THEN 'en' WHEN w1 >= w2 AND w1 >= w3 THEN 'hi'
                  WHEN w2 >= w3 THEN 'ta' ELSE 'fr' END AS lang
      FROM w)
SELECT s.file_id, s.segment_idx,
       CASE WHEN b.n IS NULL OR b.n < 50 THEN 'too_short' ELSE b.lang END AS language,
       CASE WHEN b.n IS NULL OR b.n < 50 THEN CAST(0 AS DOUBLE)
            ELSE CAST(floor((2000 * b.top + b.tot) / (2 * b.tot)) AS DOUBLE) / 1000 END AS language_confidence
FROM fx_segments s LEFT JOIN b USING (file_id, segment_idx)"""
query("detect_language", ["fx_segments"], _LANGUAGE)
query("emotion_language_blocks", ["fx_segments"], f"SELECT * FROM ({_EMOTION}) JOIN ({_LANGUAGE}) USING (file_id, segment_idx)")
QUERIES["segment_slices_blocks"] = QUERIES["segment_slices"]

# turns of 3 s inside 60 s windows of each file's frames 0..floor(max(end_ms)/1000)
cte("fx_turns", ["fx_segments"], """
WITH f AS (SELECT file_id, user_id, CAST(floor(max(end_ms) / 1000) AS BIGINT) AS last_frame FROM fx_segments GROUP BY file_id, user_id),
w AS (SELECT file_id, user_id, last_frame, wi, least(60, last_frame - 60 * wi + 1) AS dur FROM f, range(0, last_frame // 60 + 1) r(wi)),
t AS (SELECT file_id, user_id, last_frame, wi, ti, 60 * wi + 3 * ti AS s_sec, 60 * wi + least(3 * ti + 3, dur) AS e_sec
      FROM w, range(0, CAST(ceil(dur / 3) AS BIGINT)) r(ti)),
x AS (SELECT file_id, user_id, last_frame, wi, ti, s_sec, e_sec,
             sum(abs(((g // 100) * 7919 + (g % 100) * (g % 100) * 31 + user_id * 17) % 2001 - 1000)) AS sa
      FROM t, range(s_sec * 100, e_sec * 100) r(g) GROUP BY ALL)
SELECT file_id, user_id, last_frame, s_sec, e_sec,
       CAST(row_number() OVER (PARTITION BY file_id ORDER BY wi, ti) - 1 AS BIGINT) AS segment_idx,
       'SPEAKER_0' || CAST((sa * 100 // 32768) % 2 AS VARCHAR) AS speaker
FROM x""")

query("diarize", ["fx_turns"], """
SELECT file_id, segment_idx, speaker, CAST(s_sec * 1000 AS BIGINT) AS start_ms, CAST(e_sec * 1000 AS BIGINT) AS end_ms
FROM fx_turns""")

# the job over every fixture file: latest manifest row per file (all complete; languages
# from the language stand-in over each turn; duration = frames / rate)
query("annotation_run", ["fx_turns"], """
WITH x AS (SELECT t.file_id, t.segment_idx, g - t.s_sec * 100 AS k,
                  ((g // 100) * 7919 + (g % 100) * (g % 100) * 31 + t.user_id * 17) % 2001 - 1000 AS v
           FROM fx_turns t, range(t.s_sec * 100, least(t.e_sec, t.s_sec + 30) * 100) r(g)),
w AS (SELECT file_id, segment_idx,
             abs(sum(v) FILTER (WHERE k % 4 = 0)) + 32768 AS w0, abs(coalesce(sum(v) FILTER (WHERE k % 4 = 1), 0)) + 32768 AS w1,
             abs(coalesce(sum(v) FILTER (WHERE k % 4 = 2), 0)) + 32768 AS w2, abs(coalesce(sum(v) FILTER (WHERE k % 4 = 3), 0)) + 32768 AS w3
      FROM x GROUP BY file_id, segment_idx),
l AS (SELECT file_id, CASE WHEN w0 >= w1 AND w0 >= w2 AND w0 >= w3 THEN 'en' WHEN w1 >= w2 AND w1 >= w3 THEN 'hi'
                           WHEN w2 >= w3 THEN 'ta' ELSE 'fr' END AS lang FROM w),
langs AS (SELECT file_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages_detected FROM l GROUP BY file_id),
per AS (SELECT file_id, max(last_frame) AS last_frame, CAST(count(DISTINCT speaker) AS BIGINT) AS num_speakers,
               CAST(count(*) AS BIGINT) AS num_segments FROM fx_turns GROUP BY file_id)
SELECT p.file_id, 'in/audio/' || p.file_id || '.wav' AS url, 'completed' AS status, p.num_speakers, p.num_segments,
       CAST(p.last_frame + 1 AS DOUBLE) AS duration_sec, coalesce(g.languages_detected, 'unknown') AS languages_detected
FROM per p LEFT JOIN langs g USING (file_id)""")

query("stream_audio_intake", ["fx_segments"], """
WITH f AS (SELECT file_id, CAST(floor(max(end_ms) / 1000) AS BIGINT) AS last_frame FROM fx_segments GROUP BY file_id),
c AS (SELECT file_id, clip, CAST(least(600, last_frame - 600 * clip + 1) * 100 AS BIGINT) AS n_frames
      FROM f, range(0, last_frame // 600 + 1) r(clip))
SELECT file_id, CAST(clip AS BIGINT) AS clip, CAST(100 AS INTEGER) AS sample_rate, CAST(1 AS INTEGER) AS channels, n_frames,
       CAST(n_frames * 10 AS BIGINT) AS duration_ms, false AS valid, 'sample_rate' AS problems,
       CASE WHEN n_frames * 1000 < 100 * 30000 THEN 'short_audio' ELSE '' END AS warnings
FROM c""")

query("progress_elapsed", ["fx_stage_log"], """
SELECT file_id, stage,
       CAST(CASE stage WHEN 'download' THEN 20 WHEN 'diarize' THEN 45 WHEN 'emotion' THEN 65
                       WHEN 'language' THEN 80 WHEN 'annotate' THEN 100 ELSE 0 END AS DOUBLE) / 100 AS progress,
       strftime(make_timestamp(us), '%H:%M:%S') AS clock, elapsed_us
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq DESC) AS rn
      FROM (SELECT *, us - lag(us) OVER (PARTITION BY file_id ORDER BY seq) AS elapsed_us FROM fx_stage_log)
      WHERE action = 'stage')
WHERE rn = 1""")

# a job that fails for some files: silent (0 of 5), half a second (1 of 5), and windows whose first sample is a multiple of 11
query("annotation_run_failures", ["fx_turns"], """
WITH f AS (SELECT DISTINCT file_id, user_id, last_frame FROM fx_turns),
bad AS (SELECT DISTINCT file_id FROM f, range(0, last_frame // 60 + 1) r(wi)
        WHERE ((wi * 60 * 7919 + user_id * 17) % 2001 - 1000) % 11 = 0),
per AS (SELECT file_id, CAST(count(DISTINCT speaker) AS BIGINT) AS sp, CAST(count(*) AS BIGINT) AS sg FROM fx_turns GROUP BY file_id),
k AS (SELECT f.*, CASE WHEN user_id % 5 = 0 THEN 'silent' WHEN user_id % 5 = 1 THEN 'short' WHEN b.file_id IS NOT NULL THEN 'raised' ELSE 'fine' END AS kind
      FROM f LEFT JOIN bad b USING (file_id))
SELECT k.file_id, CASE WHEN kind IN ('silent', 'fine') THEN 'completed' ELSE 'failed' END AS status,
       CASE kind WHEN 'silent' THEN 'diarize' WHEN 'fine' THEN 'annotate' WHEN 'raised' THEN 'download' END AS stage,
       CASE kind WHEN 'short' THEN 'Download failed: no valid audio (missing, unreadable or under 1 s)'
                 WHEN 'raised' THEN 'Diarization failed: RuntimeError: no turns found' END AS error,
       CASE WHEN kind IN ('silent', 'fine') THEN 'completed' ELSE 'failed' END AS manifest_status,
       CASE kind WHEN 'fine' THEN sp ELSE 0 END AS num_speakers, CASE kind WHEN 'fine' THEN sg ELSE 0 END AS num_segments,
       CASE WHEN kind IN ('silent', 'fine') THEN CAST(last_frame + 1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS duration_sec
FROM k JOIN per USING (file_id)""")

QUERIES["annotation_rerun"] = QUERIES["annotation_run"]
QUERIES["annotation_stream"] = QUERIES["annotation_run"]
QUERIES["stream_state_machine"] = QUERIES["file_state"]
QUERIES["stream_progress_elapsed"] = QUERIES["progress_elapsed"]

# --- exchanged files, written and read back ---------------------------------------

query("rttm_files", ["fx_segments"], """
SELECT file_id, segment_idx, coalesce(speaker, 'UNKNOWN') AS speaker, start_ms, end_ms FROM fx_segments""")

query("foreign_annotation_files", ["fx_segments"], """
SELECT file_id, segment_idx, coalesce(speaker, 'UNKNOWN') AS speaker, start_ms, end_ms,
       coalesce(emotion, 'unknown') AS emotion, coalesce(emotion_confidence, 0) AS emotion_confidence,
       coalesce(language, 'unknown') AS language, coalesce(language_confidence, 0) AS language_confidence
FROM fx_segments WHERE CAST(substr(file_id, 2, 6) AS INTEGER) % 7 <> 0
UNION ALL SELECT DISTINCT file_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fx_segments WHERE CAST(substr(file_id, 2, 6) AS INTEGER) % 7 = 0""")

QUERIES["display_csv_files"] = f"SELECT * EXCLUDE (segment_idx) FROM ({QUERIES['segment_table']})"

query("landed_audio_listing", ["fx_segments"], """
WITH f AS (SELECT file_id, CAST(floor(max(end_ms) / 1000) AS BIGINT) AS last_frame FROM fx_segments GROUP BY file_id)
SELECT file_id, CAST(clip AS BIGINT) AS clip, 'wav' AS ext, CAST(44 + 200 * least(600, last_frame - 600 * clip + 1) AS BIGINT) AS length
FROM f, range(0, last_frame // 600 + 1) r(clip)""")

query("state_records", ["fx_state"], """
SELECT file_id, status, stage, url, strftime(make_timestamp(started_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at,
       strftime(make_timestamp(completed_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS completed_at, error
FROM fx_state""")

query("annotation_files", ["fx_segments"], """
SELECT file_id, segment_idx, coalesce(speaker, 'UNKNOWN') AS speaker, start_ms, end_ms,
       coalesce(emotion, 'unknown') AS emotion, coalesce(emotion_confidence, 0) AS emotion_confidence,
       coalesce(language, 'unknown') AS language, coalesce(language_confidence, 0) AS language_confidence
FROM fx_segments""")

query("state_files", ["fx_state"], """
SELECT file_id, status, stage, url, error FROM fx_state WHERE CAST(substr(file_id, 2, 6) AS INTEGER) % 7 <> 0
UNION ALL SELECT 'rejects', NULL, NULL, NULL, CAST(count(*) AS VARCHAR) FROM fx_state WHERE CAST(substr(file_id, 2, 6) AS INTEGER) % 7 = 0""")

query("manifest_files", ["fx_manifest"], """
SELECT file_id, url, status, num_speakers, num_segments, duration_sec, languages_detected FROM fx_manifest""")

query("input_list_files", ["fx_inputs"], "SELECT file_id, source, is_url FROM fx_inputs")

QUERIES["normalise_resampled"] = """
WITH u AS (SELECT DISTINCT user_id, 'f' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS file_id, (user_id * 37 % 201 - 100) * 256 AS v FROM events)
SELECT file_id, CAST(CASE WHEN user_id % 9 <> 8 THEN 32000 END AS BIGINT) AS n_samples,
       CAST(CASE WHEN user_id % 9 <> 8 THEN 32000 * v END AS BIGINT) AS sample_sum, CAST(CASE WHEN user_id % 9 <> 8 THEN 32000 * v * v END AS BIGINT) AS sum_sq,
       CASE WHEN user_id % 9 = 8 THEN 'not an uncompressed WAV file' END AS error
FROM u"""
