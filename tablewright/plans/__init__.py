"""Whole workflows composed of operators."""
