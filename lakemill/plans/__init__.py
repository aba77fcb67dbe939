"""Queries and serving views."""
