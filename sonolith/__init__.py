"""Collection and recording analytics as Spark DataFrame operators."""
