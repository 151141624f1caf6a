"""Service-schedule and calendar analytics as Spark DataFrame operators."""
