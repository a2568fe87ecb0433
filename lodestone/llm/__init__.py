"""Training-data operators: scans, near duplicates, extraction, archives and mixing.

Nothing outside this package imports it.
"""
