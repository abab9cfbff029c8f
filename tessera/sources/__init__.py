"""Inputs: provided tables, matrix views derived from them, generators, files."""
