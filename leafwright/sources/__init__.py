"""sources of the leafwright engine."""
