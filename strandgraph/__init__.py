"""Property-graph analytics as lazy Spark DataFrame plans."""
