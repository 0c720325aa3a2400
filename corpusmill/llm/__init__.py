"""Operators for large-scale text collections. Nothing else in corpusmill imports this package."""
