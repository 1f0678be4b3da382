"""Analytical plans over the base operators."""
