"""Warehouse builders, layouts and reports."""
