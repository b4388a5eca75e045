"""Outcome analytics for time-stamped market claims, expressed as Spark jobs."""
