"""Streams as growing relations."""
