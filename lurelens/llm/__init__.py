"""Operators for preparing training text at scale; nothing else in lurelens imports this subpackage."""
