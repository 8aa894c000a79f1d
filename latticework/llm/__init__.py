"""Training-data operators on Spark: cleaning, deduplication, classification, archives and packing.

Nothing else in the library imports this subpackage.
"""
