"""Readers of coverage reports and caches."""
