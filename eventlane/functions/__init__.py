"""Column-level building blocks (no shuffles, no I/O)."""
