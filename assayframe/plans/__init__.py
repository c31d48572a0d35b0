"""Shared physical building blocks: wide aggregates, value counts, quantiles, carries."""
