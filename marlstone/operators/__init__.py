"""Operators on whole DataFrames: windows, shapes, quality checks and materialisation."""
