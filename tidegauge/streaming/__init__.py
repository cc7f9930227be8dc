"""Incremental pick-up of newly landed responses."""
