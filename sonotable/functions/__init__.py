"""Column expressions: built-in Spark functions only, no Python per row."""

from sonotable.functions import ids, labels, rttm, timefmt

__all__ = ["ids", "labels", "rttm", "timefmt"]
