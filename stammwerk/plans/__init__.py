"""Declarative rule catalogue, coverage and the queries built from both."""
