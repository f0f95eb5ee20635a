"""operators of the leafwright engine."""
