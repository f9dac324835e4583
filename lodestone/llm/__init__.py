"""Training-data operators: packing, decontamination, quality, dedup, language ID,
chat formatting, licence scans, token files, vector search, similarity joins, hard
negatives, conversation repair and fingerprints.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
