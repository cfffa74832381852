"""Tessel: operators."""
