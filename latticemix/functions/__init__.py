"""Column functions: every function here stays inside Spark's own expressions."""
