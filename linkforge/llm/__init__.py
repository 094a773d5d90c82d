"""Corpus-preparation operators: filtering, classification, deduplication, packing, archives, tokenising.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
