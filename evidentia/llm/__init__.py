"""Operators for large training-data corpora: scoring, deduplication, mixing, decontamination, archives."""
