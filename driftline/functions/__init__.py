"""Column expressions shared by the operators, with their SQL text."""
