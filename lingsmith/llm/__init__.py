"""Training-data operators: scoring, deduplication, mixing, packing and encoding of text corpora.

Nothing else in the package imports this subpackage.
"""
