"""Readers for landed responses and for stored daily tables."""
