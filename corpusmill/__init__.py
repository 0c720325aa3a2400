"""corpusmill: analytics over a corpus of notes, documents and logs, as Spark plans."""
