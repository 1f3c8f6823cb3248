"""Operators on record sets."""
