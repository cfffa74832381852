"""Tessel: streaming."""
