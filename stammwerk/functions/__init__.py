"""Column expressions: conversions, validators, text folding."""
