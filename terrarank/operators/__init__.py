"""DataFrame operators: every function takes and returns DataFrames and is lazy unless it says so."""
