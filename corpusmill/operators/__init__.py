"""Operators of corpusmill."""
