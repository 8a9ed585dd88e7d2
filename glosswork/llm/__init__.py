"""Operators that prepare text corpora for training: scoring, deduplication, packing, archives.

Nothing else in the library imports this subpackage; see ``queries.py`` for the registered queries.
"""
