"""Operators for preparing large text corpora; each query is registered by its own module."""
