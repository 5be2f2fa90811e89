"""Stored tables, indexes and codebooks, and Arrow stream files."""
