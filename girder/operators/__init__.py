"""Relational operators that several questions share."""
