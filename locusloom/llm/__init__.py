"""Training-data pipeline operators: filtering, deduplication, scoring, mixing, packing.

Nothing outside this package imports it.  The registered queries and their SQL
are in :mod:`locusloom.llm.queries`.
"""
