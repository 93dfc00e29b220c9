"""Structured Streaming forms of the incremental jobs.

Every stream runs with a checkpoint in the shared checkpoint folder and writes
through ``foreachBatch`` into a table partitioned by ``batch_id``; a replayed
batch overwrites its own partition, so a restart after a lost executor or
driver never duplicates rows. ``trigger(availableNow=True)`` processes what is
there and stops; a second run over the same input finds nothing new.
"""
