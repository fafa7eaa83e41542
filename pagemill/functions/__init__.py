"""Column functions: pure expressions over strings, arrays, maps and variants."""
