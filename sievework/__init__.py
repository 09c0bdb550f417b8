"""Tabular data-cleaning evaluation on Spark: noise injection, profiling, cleaning plans, bounded repair."""
