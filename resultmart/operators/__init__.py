"""Table operators built from DataFrame operations."""
