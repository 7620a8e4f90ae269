"""Column expressions: text rules, scores and their SQL functions."""
