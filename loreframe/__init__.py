"""Loreframe: a PySpark engine for chapter-versioned story knowledge bases."""
