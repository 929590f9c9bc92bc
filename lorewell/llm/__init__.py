"""Operators that prepare training text at scale; nothing else in lorewell imports this subpackage."""
