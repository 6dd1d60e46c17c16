"""Schemas, readers, writers and the fixed code lists."""
