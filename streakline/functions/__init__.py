"""Column-returning helpers and fixed lookup values."""
