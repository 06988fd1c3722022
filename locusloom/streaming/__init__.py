"""The row-local operators and window counts on streaming DataFrames."""
