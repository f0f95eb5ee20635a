"""functions of the leafwright engine."""
