"""Training-data operators: search, filtering, deduplication, scoring and packing.

Nothing outside this folder imports it (``corpus_pipeline.py`` counts as part of it).
"""
