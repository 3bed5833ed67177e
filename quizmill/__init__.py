"""Question-bank analytics as Spark jobs."""
