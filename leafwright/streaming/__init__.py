"""streaming of the leafwright engine."""
