"""Readers and writers: raw snapshot feeds, registries, curated tables."""
