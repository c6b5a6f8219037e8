"""Training-data operators: tokenising, dedup, packing, scoring, filtering, search, extraction.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the thin
``opN_*`` queries that derive the published digest columns live in :mod:`orrery.llm.queries`.
"""
