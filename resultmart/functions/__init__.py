"""Column functions: text, dates, codes, arrays and maps."""
