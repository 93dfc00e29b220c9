"""DataFrame operators: each takes and returns DataFrames keyed by ``file_id``."""
