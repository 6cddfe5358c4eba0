"""Operators that prepare training text: ten document, page and url operators, each in a module of its own."""
