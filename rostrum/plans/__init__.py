"""Queries: compositions of operators over whole tables."""
