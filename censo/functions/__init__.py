"""Part of the censo engine."""
