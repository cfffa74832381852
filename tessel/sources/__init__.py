"""Tessel: sources."""
