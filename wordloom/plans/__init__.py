"""Whole questions: corpora, searches, distributions, and the registered queries."""
