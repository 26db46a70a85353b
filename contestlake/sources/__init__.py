"""Landed captures and feeds as tidy DataFrames with reject rows."""
