"""Frame-to-frame operators of the panel engine."""
