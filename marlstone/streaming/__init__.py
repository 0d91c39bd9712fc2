"""Refreshing materialised metrics from streams."""
