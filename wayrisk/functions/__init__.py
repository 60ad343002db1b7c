"""Subpackage of wayrisk."""
