"""Operators for training data; nothing outside of this package imports it."""
