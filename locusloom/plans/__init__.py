"""Composite analyses that chain operators."""
