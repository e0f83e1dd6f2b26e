"""Semantic search over catalogued items and analytics of the search log, as Spark jobs."""
