"""Training-data operators: each takes DataFrames and returns a DataFrame; nothing else in the library imports this."""
