"""Registered queries: library operators over the given tables, each beside its SQL."""
