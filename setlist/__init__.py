"""Setlist: playlist-catalogue analytics written as plain Spark DataFrame jobs."""
