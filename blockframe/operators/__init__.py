"""Row operators of the core engine."""
