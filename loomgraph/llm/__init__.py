"""Operators for building training data from very large text collections."""
