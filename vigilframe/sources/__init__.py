"""Readers, writers and the shared input views."""
