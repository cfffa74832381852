"""Tessel: plans."""
