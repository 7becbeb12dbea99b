"""Operators for building language-model training text; nothing else imports this package."""
