"""Spark-first entity resolution and master-data engine."""
