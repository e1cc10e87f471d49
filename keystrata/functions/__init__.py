"""Column functions: key parsing, bit fields, unit arithmetic and register decoding. Nothing here runs Python per row."""
