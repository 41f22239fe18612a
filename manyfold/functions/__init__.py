"""Subpackage of manyfold; see the module docstrings."""
