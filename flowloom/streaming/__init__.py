"""flowloom streaming."""
