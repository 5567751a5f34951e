"""Subpackage of quillweave."""
