"""Workforce analytics as Spark DataFrame queries."""
