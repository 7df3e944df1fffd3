"""grove: versioned, content-addressed file trees as Spark DataFrames."""
