"""Functions of corpusmill."""
