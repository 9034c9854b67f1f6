"""Column expressions and Arrow kernels."""
