"""Column expressions: hexagonal grid, geometry, risk rules, texts."""
