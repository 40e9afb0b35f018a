"""Spark-first engine for map-based exploratory analytics and corpus preparation."""
