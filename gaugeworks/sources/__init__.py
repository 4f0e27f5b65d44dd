"""Readers, guarded writers, keyed tables and report tables."""
