"""Whole queries put together from the operators."""
