"""Event-correlation analytics expressed as Spark DataFrame operators."""
