"""Operators over block tables. Each takes and returns a relation of ``plans``; ``api`` applies them to DataFrames."""
