"""Training-data operators: quality, deduplication, mixing, packing, tokenised output, archives.

Nothing outside this subpackage imports it.
"""
