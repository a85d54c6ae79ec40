"""Training-data operators: packing, scoring, decontamination, deduplication, quality rules and secret scans.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
