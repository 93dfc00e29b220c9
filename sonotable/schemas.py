"""Table schemas and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the pipeline being re-implemented for
# results to match; they are stated here plainly and in their natural order.
# ---------------------------------------------------------------------------

# ordered pipeline stages (resume logic depends on this order)
STAGES = ["download", "diarize", "emotion", "language", "annotate"]

# progress percentage reached when a stage reports (unknown stage -> 0)
STAGE_WEIGHTS = {
    "download": 20,
    "diarize": 45,
    "emotion": 65,
    "language": 80,
    "annotate": 100,
}

# display colour per emotion label; anything else -> DEFAULT_COLOR
EMOTION_COLORS = {
    "neutral": "#9E9E9E",
    "happy": "#4CAF50",
    "angry": "#F44336",
    "sad": "#2196F3",
    "fear": "#FF9800",
    "surprise": "#9C27B0",
    "disgust": "#795548",
    "too_short": "#BDBDBD",
    "error": "#E0E0E0",
    "unknown": "#BDBDBD",
}
DEFAULT_COLOR = "#9E9E9E"

# documented emotion labels, sentinels included
EMOTION_LABELS = ["neutral", "happy", "angry", "sad", "fear", "surprise", "disgust", "too_short", "error"]

# sentinel labels written in-band
TOO_SHORT = "too_short"
ERROR = "error"
UNKNOWN = "unknown"
UNKNOWN_SPEAKER = "UNKNOWN"

# audio requirements
SAMPLE_RATE = 16_000
MONO_CHANNELS = 1
MIN_AUDIO_MS = 1_000        # files shorter than 1 s are invalid
SHORT_AUDIO_MS = 30_000     # files shorter than 30 s only warn
MIN_SEGMENT_MS = 500        # segments shorter than 0.5 s skip the models
LANGUAGE_WINDOW_MS = 30_000  # language model sees at most 30 s

# audio container formats accepted by the landing scan
AUDIO_FORMATS = ["wav", "mp3", "m4a", "ogg"]

# artifact layout under an output root
RAW_DIR, AUDIO_DIR, ANNOTATIONS_DIR, LOGS_DIR = "raw", "audio", "annotations", "logs"

# error triage: first matching rule wins, else "other"
ERROR_RULES = [
    ("memory", ["out of memory"], []),      # case-insensitive needles
    ("auth", ["hf_token"], ["401"]),        # (ci needles, case-sensitive needles)
    ("tool", ["ffmpeg"], []),
]

# segment table display headers, in order (CSV export)
DISPLAY_HEADERS = ["Start", "End", "Speaker", "Duration(s)", "Emotion", "Confidence%", "Language", "Lang_confidence%"]

# manifest column order
MANIFEST_COLUMNS = [
    "file_id", "url", "status", "num_speakers", "num_segments",
    "duration_sec", "languages_detected", "processed_at",
]

# annotation record key order and defaults for absent keys
ANNOTATION_DEFAULTS = [
    ("speaker", UNKNOWN_SPEAKER),
    ("start", 0.0),
    ("end", 0.0),
    ("emotion", UNKNOWN),
    ("emotion_confidence", 0.0),
    ("language", UNKNOWN),
    ("language_confidence", 0.0),
]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

SEGMENTS = T.StructType([
    T.StructField("file_id", T.StringType(), False),
    T.StructField("segment_idx", T.LongType(), False),
    T.StructField("speaker", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("emotion_confidence", T.DoubleType()),
    T.StructField("language", T.StringType()),
    T.StructField("language_confidence", T.DoubleType()),
])

# one JSON annotation record (seconds, as exchanged)
ANNOTATION_RECORD = T.StructType([
    T.StructField("speaker", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("emotion_confidence", T.DoubleType()),
    T.StructField("language", T.StringType()),
    T.StructField("language_confidence", T.DoubleType()),
])

STAGE_EVENTS = T.StructType([
    T.StructField("file_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("us", T.LongType()),
    T.StructField("action", T.StringType()),   # started | stage | completed | failed
    T.StructField("stage", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("url", T.StringType()),
])

STATE_RECORD = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("error", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("num_speakers", T.IntegerType()),
    T.StructField("num_segments", T.IntegerType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("languages_detected", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
])

WAV_FACTS = T.StructType([
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("n_frames", T.LongType()),
    T.StructField("sample_width", T.IntegerType()),
])

AUDIO_FRAMES = T.StructType([
    T.StructField("file_id", T.StringType(), False),
    T.StructField("frame_idx", T.LongType(), False),
    T.StructField("pcm", T.BinaryType()),       # int16 little-endian, mono, 1 s
])
