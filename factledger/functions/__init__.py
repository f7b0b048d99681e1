"""Column expressions: normalisation rules, keys, text and typed values."""
