"""Column-expression builders (pure Catalyst expressions, no Python UDFs)."""
