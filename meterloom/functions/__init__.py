"""Column functions that sources and operators share."""
