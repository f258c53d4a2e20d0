"""Training-data operators: sharding, extraction, filtering, de-duplication, formatting, packing.

Nothing else in the package imports this subpackage.
"""
