"""Column functions and numerical kernels."""
