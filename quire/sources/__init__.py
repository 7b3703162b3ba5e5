"""Readers of input files and tables."""
