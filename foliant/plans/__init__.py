"""Foliant: plans."""
