"""Continuous forms: first-accepted deduplication with state, incremental cursors, upserts by micro-batch."""
