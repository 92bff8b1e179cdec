"""Training-data operators: mixing, filtering, packing and deduplication of document corpora.

Nothing else in the library imports this subpackage, and it imports nothing from the rest of
the library, so it can be removed or shipped on its own.
"""
