"""Registries, the learning loop, and the registered queries."""
