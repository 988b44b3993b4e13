"""Composed query plans and materialisation."""
