"""Tessel: functions."""
