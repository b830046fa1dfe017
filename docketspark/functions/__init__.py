"""Column functions: scalar rules and validation, all built from Spark's own expressions."""
