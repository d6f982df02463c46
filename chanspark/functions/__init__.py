"""Column expressions: channel conversions, formulas, number formats."""
