"""Training-data operators: deduplication, scanning, counting, encoding, archives and exact search.

Nothing else in the library imports this package; it can be removed whole.
"""
