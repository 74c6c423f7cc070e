"""Relational pieces: filters, windows, series metadata."""
