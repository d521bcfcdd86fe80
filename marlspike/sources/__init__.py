"""Stores and logs that are read and written."""
