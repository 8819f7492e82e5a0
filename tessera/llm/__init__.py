"""Training-data operators: mixing, search, decontamination, extraction, dedup, encoding, filters, scoring.

Nothing else in the package imports this subpackage.
"""
