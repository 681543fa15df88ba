"""Operators for preparing text corpora for training. Nothing outside this package imports it."""
