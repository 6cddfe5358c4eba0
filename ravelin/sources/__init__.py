"""Readers: structured indicator feeds, pages and their links, listings, documents, graph tables."""
