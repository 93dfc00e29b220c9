"""T1: incremental intake. Only new inputs / new audio files are processed after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonotable.functions import ids as I
from sonotable.operators import audio as AU
from sonotable.operators.inputs import clean_inputs
from sonotable.streaming.common import read_batch_log, run_available
from sonotable.streaming.keyed import first_seen


def stream_inputs(spark: SparkSession, lines: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Input lines stream -> table of new file ids (first line per id; ids of earlier micro-batches are known to the state store)."""
    ided = clean_inputs(lines).withColumn("file_id", I.file_id("source"))
    place = ["path", "line_no"] if "path" in ided.columns else ["line_no"]
    new = first_seen(ided.select("file_id", *place, "source"), "file_id", [*place, "source"])
    run_available(new, out_path, checkpoint, "append")
    return read_batch_log(spark, out_path)


AUDIO_STREAM_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_audio(spark: SparkSession, root: str, out_path: str, checkpoint: str, formats=("wav",)) -> DataFrame:
    """Landed audio folder as a stream -> table of header facts and validation per new file.

    The file source remembers processed files in its checkpoint; ``content`` is
    never selected; header facts come from a walk over the chunk headers.
    """
    src = (
        spark.readStream.format("binaryFile").schema(AUDIO_STREAM_SCHEMA)
        .option("pathGlobFilter", "*.{" + ",".join(formats) + "}")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", I.path_stem(F.col("path")).alias("file_id"), "length")
    )

    def facts(batch: DataFrame, batch_id: int) -> DataFrame:
        v = AU.validate_audio(AU.audio_headers(batch))
        return v.select("file_id", "path", "sample_rate", "channels", "n_frames", "duration_ms", "valid",
                        F.array_join("problems", ",").alias("problems"), F.array_join("warnings", ",").alias("warnings"))

    run_available(src, out_path, checkpoint, "append", transform=facts)
    return read_batch_log(spark, out_path)
