"""Table-level operators: DataFrames in, DataFrames (or bounded models) out."""
