"""Texts for readers and tools, written on the driver from rows that a cap or a threshold has bounded."""
