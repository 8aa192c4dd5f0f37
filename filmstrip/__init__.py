"""Media-library analytics and planning on Spark."""
