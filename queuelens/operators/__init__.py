"""DataFrame operators: each takes DataFrames and a profile and returns a DataFrame."""
