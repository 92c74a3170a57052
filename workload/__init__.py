"""Registered queries: each operator run over the given tables, next to plain SQL for the same result."""
