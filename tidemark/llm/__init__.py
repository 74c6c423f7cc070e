"""Training-data operators: scrubbing, deduplication, decontamination, mixing, extraction.

Nothing else in the package imports this subpackage.
"""
