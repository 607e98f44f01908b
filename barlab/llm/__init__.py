"""Operators for training-corpus preparation; nothing outside this package imports it."""
