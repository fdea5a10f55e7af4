"""Files in, tables out, and results back to files."""
