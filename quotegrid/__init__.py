"""Order-book research analytics as PySpark DataFrame and Structured Streaming jobs."""
