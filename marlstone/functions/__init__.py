"""Column builders: filter trees, calendar arithmetic and aggregates."""
