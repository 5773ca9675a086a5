"""Security event analytics on Spark."""
