"""Column expressions that contracts and queries share."""
