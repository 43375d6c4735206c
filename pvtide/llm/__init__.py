"""Training-data operators: sharding, mixing, deduplication, language ID,
quality, URL filters, fingerprints, licence scans, tokenisation, embedding
whitening, ranked search and token files.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
