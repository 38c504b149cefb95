"""Training-data pipeline operators: decontamination, deduplication, search, archives, mixing, scoring, extraction.

Nothing outside this subpackage imports it.
"""
