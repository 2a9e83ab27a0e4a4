"""Scalar helpers, each a Column expression."""
