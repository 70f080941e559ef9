"""RDF terms, readers and writers."""
