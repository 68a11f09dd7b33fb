"""Readers of landed documents and the stored tables."""
