"""Change-risk analytics on Spark."""
