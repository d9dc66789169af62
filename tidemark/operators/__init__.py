"""Operators on views, each a composition of DataFrame operations."""
