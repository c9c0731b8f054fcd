"""Column expressions shared by the operators. Nothing here runs Python per row."""
