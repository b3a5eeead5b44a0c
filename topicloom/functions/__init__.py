"""Column functions: string in, string or array out. No Python runs per row."""
