"""Column expressions: text parsing, exact means, value checks."""
