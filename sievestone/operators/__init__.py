"""Operators: each takes and returns DataFrames (or Columns) and triggers no job."""
