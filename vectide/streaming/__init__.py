"""Bounded record-batch transport."""
