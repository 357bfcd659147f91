"""Training-data operators: deduplication, filtering, tokenising, packing, search and sharding.

Nothing outside this folder imports it.  Every operator takes DataFrames and returns DataFrames;
the ``opN_*`` queries over the driver's tables are in :mod:`padaflow.llm.queries`.
"""
