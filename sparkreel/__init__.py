"""Timeline and frame analytics on Spark."""
