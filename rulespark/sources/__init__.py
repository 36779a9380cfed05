"""Data that programs read: bound frames and file loaders."""
