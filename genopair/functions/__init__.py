"""Column expressions. Everything here stays inside Spark's generated code."""
