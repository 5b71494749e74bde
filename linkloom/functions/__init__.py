"""Column expressions for hosts, text, DNS and identifiers."""
