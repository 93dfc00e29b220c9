"""T1: the annotation job as a stream. Every micro-batch of new files is one run of the job.

Files are made unique by the state store, over all micro-batches and restarts, so a batch
needs no look at earlier output: the job reads the folders of its own run only. The run
number is the batch id, and the batch is committed after all its tables are written; a batch
that is killed midway is replayed by the stream under the same id, overwrites what it had
written, and is seen by readers once it is whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonotable.plans import annotate_job
from sonotable.streaming import transaction as TX
from sonotable.streaming.keyed import first_seen


def annotate_stream(spark: SparkSession, files: DataFrame, root: str, checkpoint: str, diarizer: Callable, emotion_model: Callable,
                    language_model: Callable, audio_of: Callable[[DataFrame], DataFrame] | None = None,
                    on_write: Callable[[int, str], None] | None = None, **options) -> dict[str, DataFrame]:
    """Annotate all files that ``files`` has now, then stop; returns the committed state, manifest and annotations.

    ``files`` is a stream of (file_id, line_no, source) and, for landed WAV files, ``path``;
    else ``audio_of`` gives the frames (file_id, frame_idx, pcm) of a batch's files.
    ``on_write`` is told the batch and the table after each table written. Further options
    go to ``annotate_job.run``.
    """
    place = ["line_no", "source", *(["path"] if "path" in files.columns else [])]
    fresh = first_seen(files.select("file_id", *place), "file_id", place)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        if TX.is_committed(spark, root, batch_id):  # the batch was whole, only the stream's own log of it was lost
            return
        batch = batch.persist()
        try:
            n = batch.count()
            if n:
                annotate_job.run(
                    spark, batch.select("file_id", "line_no", "source"), root, diarizer, emotion_model, language_model,
                    audio_frames=audio_of(batch.select("file_id")) if audio_of else None,
                    landed_files=batch.select("file_id", "path") if "path" in batch.columns else None,
                    run_us=batch_id, at_us=int(time.time() * 1_000_000), fresh=True,
                    on_write=(lambda name: on_write(batch_id, name)) if on_write else None, **options)
            TX.commit(spark, root, batch_id, n)
        finally:
            batch.unpersist()

    q = fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run_batch).trigger(availableNow=True).start()
    q.awaitTermination()
    return committed_tables(spark, root)


def committed_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """State, latest manifest rows and annotations of the committed micro-batches."""
    return annotate_job.current(spark, root, TX.committed(spark, root))
