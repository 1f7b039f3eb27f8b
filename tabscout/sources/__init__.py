"""Readers and writers for table corpora, queries, vectors and run records."""
