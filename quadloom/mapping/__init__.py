"""The mapping model, and how it is loaded."""
