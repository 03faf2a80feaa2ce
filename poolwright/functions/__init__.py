"""Column expressions and numeric kernels that operators share."""
