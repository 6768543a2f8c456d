"""Training-data operators: quality, packing, near-duplicates, extraction, sharding, encoding, search.

Nothing else in the library imports this subpackage.
"""
