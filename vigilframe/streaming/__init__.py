"""Structured Streaming jobs; each one has a batch twin in operators."""
