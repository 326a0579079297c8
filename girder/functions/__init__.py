"""Column builders: pattern dialects and text predicates. All are built-in Spark expressions."""
