"""Training-data operators: each module offers one operator on DataFrames."""
