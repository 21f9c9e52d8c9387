"""Training-data operators: deduplication, packing, sharding, scoring, archives and vector search.

Nothing else in the library imports this subpackage.  Every operator takes and returns
DataFrames; per-row Python stays inside Arrow batches and Spark does the partitioning.
"""
