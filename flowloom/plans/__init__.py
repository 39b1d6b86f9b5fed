"""flowloom plans."""
