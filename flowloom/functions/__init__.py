"""flowloom functions."""
