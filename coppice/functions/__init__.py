"""Column expressions: paths, labels, names, text measures."""
