"""Operators over outline-shaped index tables."""
