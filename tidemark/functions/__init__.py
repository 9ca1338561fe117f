"""Column expressions and table functions over text and source code."""
