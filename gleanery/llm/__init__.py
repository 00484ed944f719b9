"""Training-data operators: deduplication, filtering, decontamination, tokenising.

Nothing outside this subpackage imports it.
"""
