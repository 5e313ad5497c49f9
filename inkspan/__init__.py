"""Document and hiring analytics as Spark DataFrame operators."""
