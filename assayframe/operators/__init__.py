"""User-facing operators: each takes a table (or its facts) and returns DataFrames."""
