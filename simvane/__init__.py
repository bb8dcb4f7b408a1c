"""simvane: exact, reproducible analytics over labelled, batched vectors and tables, on Spark DataFrames."""
