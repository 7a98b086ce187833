"""Streams of endpoint observations."""
