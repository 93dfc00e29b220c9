"""Readers for the exchanged file forms (input lists, RTTM, JSON arrays, state, manifest)."""
