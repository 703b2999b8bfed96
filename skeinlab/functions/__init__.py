"""Column functions: simplices, coefficients, interval ends, text."""
