"""Spark operators that turn a large, messy collection of files and texts into a searchable corpus."""
