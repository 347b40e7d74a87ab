"""Relational operators on graphs and cut sets."""
