"""Risk analytics on Spark."""
