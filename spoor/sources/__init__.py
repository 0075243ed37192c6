"""sources of the evidence engine."""
