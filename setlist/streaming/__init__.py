"""Loads that follow a folder of landed files."""
