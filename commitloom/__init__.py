"""Code-history and dependency-graph analytics as Spark DataFrame operators."""
