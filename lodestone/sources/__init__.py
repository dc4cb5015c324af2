"""Catalog, tables, text loading and storage."""
