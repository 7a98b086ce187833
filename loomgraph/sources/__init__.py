"""Workspace files as tables."""
