"""Operators that prepare documents as training data. Nothing outside this package imports it."""
