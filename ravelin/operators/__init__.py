"""Relational operators of the platform, each a composition of DataFrame operations."""
