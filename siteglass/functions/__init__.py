"""Column functions: text, URLs, HTML, payment amounts."""
