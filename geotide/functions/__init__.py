"""Scalar Column functions (geo, time)."""
