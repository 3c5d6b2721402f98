"""Operators and pipeline stages for preparing training text at scale."""
