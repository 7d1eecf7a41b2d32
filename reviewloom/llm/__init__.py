"""Operators for text that trains language models; nothing else in the library imports this package."""
