"""Operators for building training corpora, and their queries. Nothing else in the library imports this package."""
