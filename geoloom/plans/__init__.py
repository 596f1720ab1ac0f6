"""Helpers for building plans, and the registered queries."""
