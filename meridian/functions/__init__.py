"""Part of the timezone lookup engine."""
