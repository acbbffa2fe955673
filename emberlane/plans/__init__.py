"""End-to-end jobs, each a function from input DataFrames to result DataFrames."""
