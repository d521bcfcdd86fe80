"""Queries and predicates as DataFrame plans."""
