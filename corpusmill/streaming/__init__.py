"""Streaming of corpusmill."""
