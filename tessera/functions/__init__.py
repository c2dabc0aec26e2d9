"""SQL functions that Spark has not, or has with another meaning."""
