"""Column-returning text functions."""
