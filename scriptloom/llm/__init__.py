"""Operators of a training-data pipeline: scans, filters, deduplication, tokenising and classifiers."""
