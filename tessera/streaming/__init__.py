"""Folders that files keep arriving in, as streams."""
