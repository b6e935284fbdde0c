"""Registered queries with their SQL counterparts, grouped by area."""
