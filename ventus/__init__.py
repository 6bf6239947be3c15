"""Exposure analytics as ordinary Spark plans."""
