"""Values, types and built-in functions: once in Python, once as Spark columns."""
