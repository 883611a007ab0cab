"""Training-data operators: filtering, deduplication, extraction, mixing and packing.

Nothing else in the library imports this subpackage.
"""
