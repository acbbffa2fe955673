"""Column expressions: text, dates, logic, and the fixed values they use."""
