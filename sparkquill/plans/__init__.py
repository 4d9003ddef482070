"""Registered queries and the entry points built from operators."""
