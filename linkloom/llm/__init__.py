"""Training-data operators: mixing, token counts, deduplication, sharding,
nearest neighbours, packing, extraction and quality rules.

Nothing outside this subpackage imports it; it can be deleted whole.
"""
