"""Queries over the shared tables, registered by operator id."""
