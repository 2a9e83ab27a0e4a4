"""Operators over token, text, hit and segment tables."""
