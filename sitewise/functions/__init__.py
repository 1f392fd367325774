"""Column functions: everything here is a native expression, apart from the two fuzzy scorers."""
