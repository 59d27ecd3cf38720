"""driftline: web-change analytics as Spark DataFrame operators."""
