"""Operators for preparing training text: language, duplicates, leaks, secrets, pages, mixing and scoring."""
