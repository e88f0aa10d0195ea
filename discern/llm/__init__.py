"""Training-data operators (near-dedup, extraction, mixing, filtering).

Nothing else in the library imports this package; it can be removed whole.
"""
