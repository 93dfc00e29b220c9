"""sonotable: speech-annotation datasets as Spark tables and jobs.

Every table is keyed by ``file_id``; segment tables add ``segment_idx`` (the
position of a segment in its file). Times are integer milliseconds
(``start_ms``/``end_ms``); seconds are produced only at the output edge.
"""

from sonotable.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
