"""Operators over store tables."""
