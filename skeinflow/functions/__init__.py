"""Column functions: names, notations and polynomials as text."""
