"""Operators for preparing training text. Nothing outside imports this package."""
