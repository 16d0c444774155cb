"""Operators for training-data text and percentiles; nothing outside this subpackage imports it."""
