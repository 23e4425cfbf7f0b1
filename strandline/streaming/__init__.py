"""Reads as streams."""
