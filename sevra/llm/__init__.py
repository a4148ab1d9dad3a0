"""Operators that prepare text for language-model training; nothing outside imports this subpackage."""
