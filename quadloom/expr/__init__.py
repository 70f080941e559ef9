"""Expression languages: templates, IRIs, JSON paths, XML paths."""
