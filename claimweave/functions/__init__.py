"""Column expressions: text, scoring arithmetic, dates and lenient JSON."""
