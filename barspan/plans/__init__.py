"""Registered plans over the given tables."""
