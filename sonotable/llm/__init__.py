"""Operators of a training-data pipeline over ``documents`` (doc_id, text, ...).

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
