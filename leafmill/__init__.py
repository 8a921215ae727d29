"""A Spark engine for document analytics."""
