"""Readers, writers, and the raw tables."""
