"""Relational building blocks and the data-quality gate."""
