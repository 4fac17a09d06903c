"""Column functions: everything here is a plain expression over columns."""
