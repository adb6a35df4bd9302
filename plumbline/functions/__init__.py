"""Subpackage of plumbline."""
