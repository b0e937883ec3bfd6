"""Foliant: sources."""
