"""Table operators: every function maps DataFrames to DataFrames, all projects at once."""
