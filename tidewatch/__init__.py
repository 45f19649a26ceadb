"""Network threat analytics as Spark DataFrame operators."""
