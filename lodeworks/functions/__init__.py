"""Column expressions over text, HTML, rules and chunks."""
