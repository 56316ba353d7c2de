"""Contract-checked graph queries over Spark tables."""
