"""Training-data operators: sharding, mixing, token counts, classifiers, packing, near-duplicates, search.

Nothing outside this subpackage imports it.
"""
