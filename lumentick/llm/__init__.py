"""Training-data operators: token counts, quality, deduplication, mixing, extraction and archives.

Nothing outside this subpackage imports it.
"""
