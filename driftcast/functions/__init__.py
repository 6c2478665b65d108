"""Column expressions: bits, random numbers, colours and blocks."""
