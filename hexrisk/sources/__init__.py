"""Readers, writers, the current-state table and feeds derived from benchmark tables."""
