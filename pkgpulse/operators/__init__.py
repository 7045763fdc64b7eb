"""DataFrame -> DataFrame operators (lazy; no actions, no I/O)."""
