"""Wireless traffic analytics as Spark jobs."""
