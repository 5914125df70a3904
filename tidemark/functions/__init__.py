"""Column expressions and the scale-safe building blocks used by operators."""
