"""Shared plan shapes and the query catalogue."""
