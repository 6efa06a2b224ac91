"""Column-level functions: every one returns a Spark ``Column``."""
