"""Walking-route analytics as Spark DataFrame operators."""
