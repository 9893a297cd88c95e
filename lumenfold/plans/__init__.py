"""Registered queries: each applies operators to whole tables, beside its SQL."""
