"""File-stream ingest of vectors."""
