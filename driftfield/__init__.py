"""Feature identification, tracking and track analytics as Spark DataFrame plans."""
