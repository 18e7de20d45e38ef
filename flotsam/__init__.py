"""Marine-litter survey analytics as Spark DataFrame operators."""
