"""Operators on observations, records and columns."""
