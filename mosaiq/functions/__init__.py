"""Column builders: text, paths, spans."""
