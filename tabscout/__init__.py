"""Table retrieval on Spark: corpora, views, samples, search, ranking metrics."""
