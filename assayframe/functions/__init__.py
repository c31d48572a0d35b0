"""Column expressions: coercions, rounding and statistics formulas."""
