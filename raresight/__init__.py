"""Rare-event screening analytics as Spark DataFrame jobs."""
