"""Folding contributions to items, and fixpoints of recursive relations."""
