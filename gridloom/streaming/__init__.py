"""Files read as they arrive."""
