"""flowloom sources."""
