"""Training-data operators: tokenisation, scoring, near-duplicates, packing and privacy.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
