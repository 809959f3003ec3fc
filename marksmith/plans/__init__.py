"""Query catalog: each registered query reads the given tables and composes operators."""
