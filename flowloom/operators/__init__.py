"""flowloom operators."""
