"""Cutting lineage, and timers of a driver's steps."""
