"""Market-network analytics on Spark."""
