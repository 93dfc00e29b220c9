"""Readers for the exchanged file forms: input lists, RTTM, JSON annotations,
state snapshots and manifests. Each returns a DataFrame keyed by ``file_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonotable import schemas as S
from sonotable.functions import ids as I
from sonotable.functions import rttm as R
from sonotable.operators.inputs import clean_inputs
from sonotable.operators.sequence import positional_index
from sonotable.session import scratch_path
from sonotable.storage import exists, few_listing_tasks


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, _blk, _pos, line) with the splittable line reader.

    Within one file, line order is (start offset of the split, order inside the
    split); ``monotonically_increasing_id`` gives the second because a split is
    read in order inside its task. Large files are read by many tasks.
    """
    with few_listing_tasks(spark):
        lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_pos"),
        F.col("value").alias("line"),
    )


def _landed(parsed: DataFrame, name: str) -> DataFrame:
    """``parsed`` as a table in the shared checkpoint folder, for what reads it several times.

    Opening many small files costs more than all else: they are opened once, here. The
    table's own parts are of Spark's advisory size, however many files were read.
    """
    path = scratch_path(parsed.sparkSession, name)
    parsed.hint("rebalance").write.parquet(path)
    return parsed.sparkSession.read.schema(parsed.schema).parquet(path)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) with dense 0-based line positions per file."""
    return positional_index(raw_lines(spark, path), "path", ["_blk", "_pos"], "_blk", name="line_no").drop("_blk", "_pos")


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Input list text file(s) -> (path, line_no, source, is_url, file_id); ``#`` lines and blanks dropped.

    ``line_no`` is the 0-based line position in its file. The order of inputs is
    (path, line_no): of a repeated id the first line in that order wins downstream.
    """
    return clean_inputs(ordered_lines(spark, path)).withColumn("file_id", I.file_id("source"))


def read_rttm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """RTTM file(s) -> (segments, rejects).

    Lines with at least 9 fields starting ``SPEAKER`` are segments; others are
    skipped. A line with a non-numeric start or duration goes to ``rejects``
    and the rest of the file is kept. ``segment_idx`` is the position among the
    accepted lines of a file id, over all parts read, by part name and line.
    The files are read once, when this is called.
    """
    parsed = raw_lines(spark, path).select("*", R.parse_line("line").alias("p")).where(F.col("p.is_speaker"))
    parsed = _landed(parsed.select("path", "_blk", "_pos", F.when(~F.col("p.ok"), F.col("line")).alias("line"), "p"), "rttm-lines")
    good = parsed.where(F.col("p.ok")).select("path", "_blk", "_pos", "p.*")
    segs = positional_index(good, "file_id", ["path", "_blk", "_pos"], F.struct("path", "_blk"), name="segment_idx")
    rejects = parsed.where(~F.col("p.ok")).select("path", F.col("_blk").alias("block_start"), "line")
    return segs.select("file_id", "segment_idx", "speaker", "start_ms", "end_ms"), rejects


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON annotation files (one array per file, ``<file_id>.json``) -> (segments, rejects).

    A JSON document cannot be split, so each file is one row here: this is the
    interchange form of one recording (the canonical store is the parquet
    segments table, and ``parse_annotation_lines`` reads this package's own
    one-element-per-line export with the splittable reader).

    The file id is the file name stem. A file that is not a JSON array of
    objects (object, scalar array, truncated text) is a reject, not an empty
    file. Absent keys read as null and take defaults in ``normalise``.
    """
    if not exists(spark, path):  # a missing annotation file reads as no segments
        return (_empty(spark, "file_id string, segment_idx long, speaker string, start_ms long, end_ms long, "
                              "emotion string, emotion_confidence double, language string, language_confidence double"),
                _empty(spark, "file_id string, name string"))
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    arr_t = T.ArrayType(S.ANNOTATION_RECORD)
    is_array = F.json_array_length("value").isNotNull()
    decoded = raw.select(
        I.path_stem(F.col("name")).alias("file_id"), "name", is_array.alias("_is_array"),
        F.when(is_array, F.from_json("value", arr_t)).alias("_arr"),
    )
    ok = F.col("_is_array") & F.col("_arr").isNotNull()
    rejects = decoded.where(~ok).select("file_id", "name")
    segs = decoded.where(ok).select("file_id", F.posexplode("_arr").alias("segment_idx", "r")).select(
        "file_id",
        F.col("segment_idx").cast("long"),
        F.col("r.speaker").alias("speaker"),
        F.round(F.col("r.start") * 1000).cast("long").alias("start_ms"),
        F.round(F.col("r.end") * 1000).cast("long").alias("end_ms"),
        F.col("r.emotion").alias("emotion"),
        F.col("r.emotion_confidence").alias("emotion_confidence"),
        F.col("r.language").alias("language"),
        F.col("r.language_confidence").alias("language_confidence"),
    )
    return segs, rejects


def read_annotation_arrays(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """``read_annotations`` for files of any size: below ``root``, read by byte ranges (``sources.json_arrays``).

    Rejects carry the reason: (file_id, path, error).
    """
    from sonotable.sources.json_arrays import read_json_arrays

    found, bad = read_json_arrays(spark, root, **options)
    file_id = I.path_stem(F.col("path")).alias("file_id")
    recs = found.select(file_id, F.col("idx").alias("segment_idx"), F.from_json("element", S.ANNOTATION_RECORD).alias("r"))
    segs = recs.select(
        "file_id", "segment_idx", F.col("r.speaker").alias("speaker"), F.round(F.col("r.start") * 1000).cast("long").alias("start_ms"),
        F.round(F.col("r.end") * 1000).cast("long").alias("end_ms"), *[F.col(f"r.{c}").alias(c) for c in ("emotion", "emotion_confidence", "language", "language_confidence")])
    return segs, bad.select(file_id, "path", "error")


def parse_annotation_lines(lines: DataFrame) -> DataFrame:
    """Element lines written by ``sinks.annotation_lines`` -> segment rows (seconds)."""
    body = F.regexp_replace(F.col("line"), r"^\s*[\[,]\s*|\s*\]\s*$", "")
    elements = ~F.col("line").rlike(r"^\s*\[?\s*\]\s*$")  # not a closer or an empty array
    recs = lines.where(elements).select(
        "file_id", F.col("line_idx").alias("segment_idx"), F.from_json(body, S.ANNOTATION_RECORD).alias("r")
    )
    return recs.select("file_id", "segment_idx", *[F.col(f"r.{k}").alias(k) for k, _ in S.ANNOTATION_DEFAULTS])


def read_annotation_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``sinks.write_annotations`` wrote -> (segments, rejects).

    The exchange form of a large set is one folder ``file_id=<id>`` per file, its parts
    holding one array element per line in part order: read by lines, with the id from the
    folder. Concatenated, the parts of a folder are one JSON document. The files are read
    once, when this is called.
    """
    with few_listing_tasks(spark):
        lines = spark.read.schema("value string, file_id string").text(path)
    lines = lines.select(
        "file_id", F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_pos"), F.col("value").alias("line"))
    element = ~F.col("line").rlike(r"^\s*\[?\s*\]\s*$")
    body = F.regexp_replace("line", r"^\s*[\[,]\s*|\s*\]\s*$", "")
    ok = F.try_parse_json(body).isNotNull()
    lines = lines.where(F.trim("line") != "").select("*", element.alias("_element"), ok.alias("_ok"))
    lines = _landed(lines.select("file_id", "part", "_blk", "_pos", "_element", "_ok", F.when(~F.col("_ok"), F.col("line")).alias("line"),
                                 F.when(F.col("_element"), F.from_json(body, S.ANNOTATION_RECORD)).alias("r")), "annotation-lines")
    rejects = lines.where("_element and not _ok").select("file_id", "line")
    lines = positional_index(lines.drop("line"), "file_id", ["part", "_blk", "_pos"], F.struct("part", "_blk"), name="line_idx")
    parsed = lines.where("_element")
    segs = parsed.where("_ok").select(
        "file_id", F.col("line_idx").alias("segment_idx"), F.col("r.speaker").alias("speaker"),
        F.round(F.col("r.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("r.end") * 1000).cast("long").alias("end_ms"),
        F.col("r.emotion").alias("emotion"), F.col("r.emotion_confidence").alias("emotion_confidence"),
        F.col("r.language").alias("language"), F.col("r.language_confidence").alias("language_confidence"))
    return segs, rejects


def read_file_state(spark: SparkSession, path: str, with_rejects: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """State snapshot(s) -> one row per file (and the rejected lines or files).

    The export has one ``{file_id: record}`` object per line and is read by lines: a bad
    line is a reject and all others count. A file in which no line is an object by itself
    is read as one document, pretty-printed or not; if it isn't one, it is a reject.
    """
    mt = T.MapType(T.StringType(), S.STATE_RECORD)
    state_t = "file_id string, status string, stage string, url string, started_at string, completed_at string, error string"
    if not exists(spark, path):  # no snapshot yet: a fresh start
        none = _empty(spark, state_t), _empty(spark, "path string, line string")
        return none if with_rejects else none[0]
    one_line = r"^\s*\{\s*\"(?:[^\"\\\\]|\\\\.)*\"\s*:\s*\{.*\}\s*\}\s*$"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")
    m = F.when(F.col("line").rlike(one_line) & F.try_parse_json("line").isNotNull(), F.from_json("line", mt))
    parsed = lines.select("path", "line", m.alias("m"))
    by_line = parsed.groupBy("path").agg(F.count("m").alias("n")).where("n > 0").select("path")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    whole = whole.join(by_line, "path", "left_anti").where(F.trim("line") != "").select(
        "path", "line", F.when(F.try_parse_json("line").isNotNull(), F.from_json("line", mt)).alias("m"))
    every = parsed.join(by_line, "path", "left_semi").unionByName(whole)
    state = every.where("m is not null").select(F.explode("m").alias("file_id", "r")).select("file_id", "r.*")
    bad = every.where("m is null").select("path", F.explode(F.split("line", r"\r?\n")).alias("line")).where(F.trim("line") != "")
    return (state, bad) if with_rejects else state


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV(s) with header, read with a fixed schema (no inference)."""
    return spark.read.csv(path, header=True, schema=S.MANIFEST, timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")
