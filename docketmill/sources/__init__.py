"""Readers: bytes, web pages, office files and mail as typed tables."""
