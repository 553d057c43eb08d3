"""Loomtext."""
