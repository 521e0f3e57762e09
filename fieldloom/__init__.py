"""Document-field analytics as Spark DataFrame plans."""
