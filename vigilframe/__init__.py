"""Batch and streaming security-telemetry analytics as Spark jobs."""
