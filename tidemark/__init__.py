"""Time-window threshold detection over event streams, as Spark jobs."""
