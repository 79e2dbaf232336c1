"""Training-data operators: deduplication, filtering, tokenization, packing, sharding.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
