"""Subpackage of themeloom."""
