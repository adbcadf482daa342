"""Training-data operators: quality rules, byte-level BPE, toxicity, PII, quality classification, HTML
extraction, sharding, decontamination, token counts, the n-gram Jaccard join, best-fit packing, ranked lexical
search and embedding whitening.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Operators take DataFrames and return
DataFrames; ``queries`` registers one query per operator over the driver's tables.
"""
