"""Subpackage of quillspark."""
