"""Column expressions: hex words, ray maths, addresses, text, topics."""
