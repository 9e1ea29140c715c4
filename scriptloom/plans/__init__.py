"""Whole queries: the catalogue that ``__spark_entry__`` registers."""
