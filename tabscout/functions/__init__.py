"""Column builders: hashes and ids, table views, names, vectors."""
