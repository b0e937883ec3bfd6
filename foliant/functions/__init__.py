"""Foliant: functions."""
