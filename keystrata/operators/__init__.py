"""Joins, sorts, range pruning and metering as DataFrame compositions."""
