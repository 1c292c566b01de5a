"""Training-data operators: quality, deduplication, tokens, packing, scoring.

One module per operator; ``queries.py`` registers their thin ``opN_*`` queries.
Nothing outside this package imports it except ``__spark_entry__`` (guarded)
and ``corpus_pipeline.py``.
"""
