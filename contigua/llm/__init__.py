"""Operators for preparing training text at scale; nothing else in the package imports this."""
