"""Queries that run every operator over the test tables."""
