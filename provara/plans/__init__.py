"""Queries and the service over the operators."""
