"""Column functions: text clean-up, addresses, markup and JSON-LD."""
